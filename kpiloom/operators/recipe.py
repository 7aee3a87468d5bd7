"""Report recipes: generation from interview answers, and running them."""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kpiloom.functions.numbers import is_numeric, round_kpi
from kpiloom.functions.text import chart_title, formula_identifiers
from kpiloom.operators.kpi import column_totals


def rename_columns(df: DataFrame, column_mappings: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(column_mappings)


def derive_columns(df: DataFrame, expressions: dict[str, Column]) -> DataFrame:
    return df.withColumns(expressions)


def apply_filters(df: DataFrame, offered: Sequence[str], chosen: dict[str, Sequence]) -> DataFrame:
    """Keep rows whose value is among those chosen, for columns the recipe offers."""
    for column, values in chosen.items():
        if column not in offered:
            raise ValueError(f"'{column}' is not a filter of this recipe")
        df = df.where(F.col(column).isin(list(values)))
    return df


def right_hand_side(formula: str) -> str:
    return re.sub(r"^\s*[A-Za-z_]\w*\s*=", "", formula).strip()


def formula_columns(formula: str) -> list[str]:
    tree = ast.parse(right_hand_side(formula), mode="eval")
    return [n.id for n in ast.walk(tree) if isinstance(n, ast.Name)]


def formula_value(formula: str, totals: dict[str, Column]) -> Column:
    """Arithmetic over column totals; a division by zero gives null.

    Only names, numbers, ``+ - * /`` and parentheses are accepted.
    """
    def build(node) -> Column:
        if isinstance(node, ast.Name):
            return totals[node.id]
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.BinOp):
            left, right = build(node.left), build(node.right)
            if isinstance(node.op, ast.Add):
                return left + right
            if isinstance(node.op, ast.Sub):
                return left - right
            if isinstance(node.op, ast.Mult):
                return left * right
            if isinstance(node.op, ast.Div):
                return F.try_divide(left, right)
        raise ValueError(f"not an arithmetic formula: {formula!r}")

    return build(ast.parse(right_hand_side(formula), mode="eval").body)


def formula_kpis(facts: DataFrame, kpis: Sequence[tuple[str, str]],
                 group_by: Sequence[Column | str] = (), exact: bool = True) -> DataFrame:
    """Recipe KPIs given as (name, formula): every column is summed, then the formula applied."""
    groups = [F.col(g) if isinstance(g, str) else g for g in group_by]
    numeric = {f.name for f in facts.schema.fields if is_numeric(f.dataType)}
    used = [c for _, formula in kpis for c in formula_columns(formula)]
    totals, where = column_totals(facts, [c for c in used if c in numeric], groups, exact)
    rows = []
    for position, (name, formula) in enumerate(kpis):
        columns = formula_columns(formula)
        formula_value(formula, {c: F.lit(0.0) for c in columns})  # refuses other than arithmetic
        gaps = [c for c in columns if c not in numeric]
        if gaps:
            text = "missing" if gaps[0] not in facts.columns else "is not numeric"
            value = F.lit(None).cast("double")
            flag = F.lit(f"column '{gaps[0]}' {text}")
        else:
            value = formula_value(formula, where)
            flag = F.when(value.isNull(), F.lit("denominator is zero"))
        rows.append(F.struct(
            F.lit(position).alias("position"), F.lit(name).alias("name"),
            round_kpi(value).alias("value"), F.array_compact(F.array(flag)).alias("flags"),
        ))
    kept = [c for c in totals.columns if c != "_rows" and not c.startswith("_total")]
    return totals.select(*kept, F.inline(F.array(*rows)))


def run_recipe(df: DataFrame, config: dict, chosen: dict[str, Sequence] | None = None,
               period: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """KPIs of an approved recipe per period and dimension value."""
    from kpiloom.functions.dates import grain
    from kpiloom.operators.kpi import within_period

    df = within_period(df, config["date_column"], *period)
    df = apply_filters(df, config["filters"], chosen or {})
    groups = [grain(F.col(config["date_column"]), config["granularity"]).alias("period"),
              *config["dimensions"]]
    return formula_kpis(df, [(k["name"], k["formula"]) for k in config["kpis"]], groups)


def referenced_columns(date_column: Column, dimensions: Column, filters: Column,
                       kpis: Column) -> Column:
    """Distinct, sorted names used anywhere in a recipe."""
    dated = F.when(F.coalesce(date_column, F.lit("")) != "", F.array(date_column)).otherwise(
        F.array().cast("array<string>"))
    named = F.flatten(F.transform(kpis, lambda k: formula_identifiers(k["formula"])))
    return F.array_sort(F.array_distinct(F.concat(dated, dimensions, filters, named)))


def chart_layout(kpis: Column, dimensions: Column) -> Column:
    """A line chart per KPI, then a bar chart by the first dimension for the first two."""
    dimension = F.get(dimensions, F.lit(0))
    lines = F.transform(kpis, lambda k: F.struct(
        F.lit("line").alias("type"), k["name"].alias("kpi"),
        chart_title(k["name"]).alias("title"), F.lit(None).cast("string").alias("group_by"),
    ))
    bars = F.transform(F.slice(kpis, 1, 2), lambda k: F.struct(
        F.lit("bar").alias("type"), k["name"].alias("kpi"),
        chart_title(k["name"], dimension).alias("title"), dimension.alias("group_by"),
    ))
    return F.when(F.size(dimensions) > 0, F.concat(lines, bars)).otherwise(lines)


def generate_recipes(answers: DataFrame) -> DataFrame:
    """Recipe configuration of each interview answer row; no row leaves its partition."""
    columns = referenced_columns(
        F.col("date_column"), F.col("dimensions"), F.col("filters"), F.col("kpis"))
    return answers.select(
        "upload_id", "dataset_id",
        F.map_from_arrays(columns, columns).alias("column_mappings"),
        "date_column", "granularity", "dimensions", "filters", "kpis",
        chart_layout(F.col("kpis"), F.col("dimensions")).alias("chart_layout"),
    )


def layout_rows(recipes: DataFrame) -> DataFrame:
    """One row per chart of each recipe.

    The outer form is used because the plain one adds a filter that builds the layout again.
    """
    return (
        recipes.select("upload_id", F.posexplode_outer("chart_layout").alias("position", "c"))
        .where(F.col("position").isNotNull()).select("upload_id", "c.*", "position")
    )


def approve_recipes(recipes: DataFrame, approvals: DataFrame,
                    definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stamp approved recipes, and replace the whole configuration of those approved with a new one.

    ``approvals`` has one row per recipe: recipe_id, approved_by, approved_at, kpis (null when the
    config was not edited) and any other column of the configuration. An edited configuration
    replaces every column that ``approvals`` brings, also by null; the stamp alone leaves them.
    Returns recipes and KPI definition rows.
    """
    stamps = {"approved_by", "approved_at"}
    brought = [c for c in approvals.columns if c in recipes.columns and c != "recipe_id"]
    stamp = approvals.select("recipe_id", *[F.col(c).alias(f"_new_{c}") for c in brought])
    edit = F.col("_new_kpis").isNotNull()
    stamped = recipes.join(stamp, "recipe_id", "left").withColumns({
        c: F.coalesce(f"_new_{c}", c) if c in stamps else F.when(edit, F.col(f"_new_{c}")).otherwise(F.col(c))
        for c in brought}).select(*recipes.columns)
    edited = approvals.where(F.col("kpis").isNotNull())
    fresh = (
        edited.join(recipes.select("recipe_id", "client_id"), "recipe_id")
        .select("client_id", "recipe_id", F.explode("kpis").alias("k"))
        .select("client_id", "recipe_id", "k.name", "k.formula")
    )
    kept = definitions.join(edited.select("recipe_id"), "recipe_id", "left_anti")
    return stamped, kept.select(*fresh.columns).unionByName(fresh)
