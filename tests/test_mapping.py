import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kpiloom.functions.similarity import best_candidate, name_score
from kpiloom.operators import mapping
from kpiloom.plans.mapping_queries import header_match_exact

PAIRS = [("l_extendedprice", "extended_price", 0.8966), ("Total Dials", "total_dials", 0.9091),
         ("l_tax", "tax_amount", 0.4), ("tide", "diet", 0.25), ("diet", "tide", 0.5)]


def test_similarity_of_the_edge_fixture():
    for a, b, want in PAIRS:
        assert round(name_score(a, b), 4) == want


def test_bounds_never_change_the_winner():
    rng = random.Random(5)
    for _ in range(300):
        word = lambda: "".join(rng.choice("abcd_") for _ in range(rng.randrange(0, 9)))
        header, options = word(), [word() for _ in range(6)]
        best, where = 0.0, -1
        for i, o in enumerate(options):
            s = name_score(header, o)
            if s > best:
                best, where = s, i
        assert best_candidate(header, options) == (best, where)


def test_bounds_of_long_equal_and_empty_names():
    """From 200 letters on the matcher leaves out frequent ones, so equal names may score less than 1."""
    long = ["a" * 250, "ab" * 120, "".join(map(chr, range(32, 127))) * 3, "a" * 199]
    names = [*long, "", "  ", "x", " X ", "unit", "tinu"]
    for header in names:
        best, where = 0.0, -1
        for i, o in enumerate(names):
            s = name_score(header, o)
            if s > best:
                best, where = s, i
        assert best_candidate(header, names) == (best, where)


CATALOG = [
    ("contact_rate", ["live_contacts", "contacts"], "live_contacts", "total_dials", ["LCP"]),
    ("dials", [], "total_dials", "_none_", ["dial count"]),
    ("none_like", [], "zzz", "_none_", []),
]


def brute_force(headers, kpi_list):
    found = {}
    for kpi_id, fields, num, den, aliases in CATALOG:
        if kpi_id not in kpi_list:
            continue
        best, match = 0.0, None
        for h in headers:
            for c in [*fields, num, den, *aliases]:
                if c == "_none_":
                    continue
                s = SequenceMatcher(None, h.lower().strip(), c.lower().strip()).ratio()
                if s > best:
                    best, match = s, h
        found[kpi_id] = (match, round(best, 2), best < 0.7)
    return found


def test_header_match_equals_brute_force(spark):
    catalog = spark.createDataFrame(
        CATALOG, "kpi_id string, source_fields array<string>, numerator string, denominator string, aliases array<string>")
    files = {1: ["Agent", "Total Dials", "Live Contacts", "total dials"], 2: ["contacts", "contact"],
             3: ["###", "qq"], 4: ["live_contact"]}
    asked = {1: ["contact_rate", "dials", "unknown"], 2: ["contact_rate"], 3: ["none_like", "dials"], 4: ["none_like"]}
    headers = spark.createDataFrame(
        [(u, i, h) for u, hs in files.items() for i, h in enumerate(hs)], "upload_id int, position int, header string")
    requests = spark.createDataFrame(list(asked.items()), "upload_id int, kpi_list array<string>")
    got = {}
    for r in mapping.match_headers(headers, requests, catalog).collect():
        got.setdefault(r["upload_id"], {})[r["kpi_id"]] = (r["raw_column"], r["confidence"], r["needs_review"])
    assert got == {u: brute_force(files[u], asked[u]) for u in files}


def planned(spark):
    """The plan of a match whose catalog and requests are too small for any hint-free plan to shuffle them."""
    catalog = spark.createDataFrame(
        CATALOG, "kpi_id string, source_fields array<string>, numerator string, denominator string, aliases array<string>")
    headers = spark.createDataFrame([(1, 0, "Total Dials"), (1, 1, "contacts")], "upload_id int, position int, header string")
    requests = spark.createDataFrame([(1, ["contact_rate", "dials"])], "upload_id int, kpi_list array<string>")
    found = mapping.match_headers(headers, requests, catalog)
    return found._jdf.queryExecution().executedPlan().toString()


def test_a_pair_is_scored_once(spark):
    assert planned(spark).count("ArrowEvalPython [") == 1


def test_pairs_pass_their_scores_unsorted(spark):
    """Sorting the pairs by (header, KPI) takes memory as a common header has rows; a broadcast of the requests
    takes it as all uploads have."""
    plan = planned(spark)
    assert "ShuffledHashJoin [header" in plan
    assert not re.search(r"Sort \[header#\d+ ASC", plan)
    assert not re.search(r"BroadcastHashJoin \[upload_id", plan)


def test_match_keeps_null_keys_and_repeated_requests(spark):
    catalog = spark.createDataFrame(
        CATALOG, "kpi_id string, source_fields array<string>, numerator string, denominator string, aliases array<string>")
    headers = spark.createDataFrame(
        [(1, 0, "contacts"), (1, 0, "CONTACTS"), (1, 1, None), (None, 0, "contacts")], "upload_id int, position int, header string")
    requests = spark.createDataFrame(
        [(1, ["contact_rate"]), (1, ["contact_rate"]), (None, ["dials", "dials"]), (2, None)], "upload_id int, kpi_list array<string>")
    got = sorted((r["upload_id"] or 0, r["kpi_id"], r["raw_column"], r["confidence"], r["needs_review"])
                 for r in mapping.match_headers(headers, requests, catalog).collect())
    assert got == [(0, "dials", None, 0.0, True), *[(1, "contact_rate", "contacts", 1.0, False)] * 2]


def test_review_threshold_uses_the_unrounded_score(spark):
    rows = spark.createDataFrame([(1, True), (1, False), (2, False)], "upload_id int, needs_review boolean")
    got = {r["upload_id"]: r for r in mapping.review_load(rows).collect()}
    assert got[1]["message"] == "1 mapping(s) need user confirmation (confidence < 0.7)."
    assert got[2]["message"] == "All mappings auto-resolved. Please confirm to proceed."


def records(spark, rows):
    return spark.createDataFrame(rows, "request_id string, kpi_id string, record map<string,string>")


def test_merges(spark):
    old = records(spark, [("r", "k", {"raw_column": "a", "confidence": ".9"}), ("r", "kept", {"raw_column": "b"})])
    new = records(spark, [("r", "k", {"denominator_column": "d"}), ("r", "n", {"raw_column": "c"})])
    keys = ["request_id", "kpi_id"]
    whole = {r["kpi_id"]: r["record"] for r in mapping.merge_whole(old, new, keys).collect()}
    assert whole == {"k": {"denominator_column": "d"}, "kept": {"raw_column": "b"}, "n": {"raw_column": "c"}}
    deep = {r["kpi_id"]: r["record"] for r in mapping.merge_fields(old, new, keys).collect()}
    assert deep["k"] == {"raw_column": "a", "confidence": ".9", "denominator_column": "d"}
    nulled = mapping.merge_fields(old, records(spark, [("r", "k", {"raw_column": None})]), keys)
    assert {r["kpi_id"]: r["record"] for r in nulled.collect()}["k"] == {"raw_column": None, "confidence": ".9"}
    same = mapping.merge_fields(old, new.limit(0), keys)
    assert {r["kpi_id"]: r["record"] for r in same.collect()} == {r["kpi_id"]: r["record"] for r in old.collect()}


def test_memory_counts_every_approval(spark):
    memory = spark.createDataFrame([], "client_id string, template_type string, mappings string, approved_by string, use_count int")
    approvals = spark.createDataFrame(
        [("c", "t", 1, "first", "a"), ("c", "t", 2, "second", "b")],
        "client_id string, template_type string, seq int, mappings string, approved_by string")
    once = mapping.upsert_memory(memory, approvals)
    row = once.first()
    assert (row["mappings"], row["approved_by"], row["use_count"]) == ("second", "b", 2)
    assert mapping.upsert_memory(once, approvals).first()["use_count"] == 4


def test_memory_lookup_needs_both_keys(spark):
    memory = spark.createDataFrame([("c", "t", "m", 3)], "client_id string, template_type string, mappings string, use_count int")
    requests = spark.createDataFrame([("1", "c", "t"), ("2", "c", None), ("3", "x", "t")],
                                     "request_id string, client_id string, template_type string")
    got = {r["request_id"]: r["exists"] for r in mapping.lookup_memory(requests, memory).collect()}
    assert got == {"1": True, "2": False, "3": False}


def dealt_out(monkeypatch):
    """The pairs that match_headers hands over to be scored."""
    given, real = [], mapping.header_scores
    monkeypatch.setattr(mapping, "header_scores", lambda pairs, *rest: given.append(pairs) or real(pairs, *rest))
    return given


def test_settled_pairs_are_not_dealt_out(spark, monkeypatch):
    """A name that equals a header, or shares no letter with any, is settled where header and KPI meet."""
    given = dealt_out(monkeypatch)
    catalog = spark.createDataFrame(
        CATALOG, "kpi_id string, source_fields array<string>, numerator string, denominator string, aliases array<string>")
    files = {1: ["Agent", " TOTAL_DIALS\t", "total_dials"], 2: ["###"], 3: ["total dials"]}
    headers = spark.createDataFrame(
        [(u, i, h) for u, hs in files.items() for i, h in enumerate(hs)], "upload_id int, position int, header string")
    requests = spark.createDataFrame([(u, ["dials", "unknown"]) for u in files], "upload_id int, kpi_list array<string>")
    found = mapping.match_headers(headers, requests, catalog, settle=True)
    got = {r["upload_id"]: (r["raw_column"], r["confidence"]) for r in found.collect()}
    assert got == {1: (" TOTAL_DIALS\t", 1.0), 2: (None, 0.0), 3: ("total dials", 0.91)}
    assert [(r["upload_id"], r["header"]) for r in given[0].collect()] == [(3, "total dials")]


def test_exact_headers_are_not_dealt_out(spark, monkeypatch, tmp_path):
    given = dealt_out(monkeypatch)
    spark.createDataFrame([(k, 5 + k % 3, f"part {k}", "TYPE", 1.5) for k in range(4)],
                          "p_partkey bigint, p_size int, p_name string, p_type string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(o, o % 5, n) for o in range(6) for n in range(1, 5)],
                          "l_orderkey bigint, l_partkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = header_match_exact(spark, str(tmp_path)).collect()
    assert len(got) == 5 * 4 and {r["confidence"] for r in got} == {0.0, 1.0}
    assert given[0].count() == 0


@pytest.mark.parametrize("settle", [False, True])
def test_match_of_odd_names_equals_brute_force(spark, settle):
    """Names that Python trims, lowers or weighs otherwise than Spark, null positions, and keys, KPIs and ids that repeat."""
    rng = random.Random(11)
    pool = ["units", "UNITS", " units ", "\tunits\n", "\x1cunits", " units", "unıts", "UNİTS", "Kelvin", "kelvin", "KELVIN",
            "ab" * 120, "AB" * 120, "a" * 199, "A" * 200, "", "  ", "###", "stinu", "orders", "orders_1", "…", "😀"]
    for k in range(6):
        ids = [f"k{rng.randrange(5)}" for _ in range(6)]
        rows = [(i, rng.sample(pool, rng.randrange(3)), rng.choice([None, *pool]), rng.choice(["_none_", *pool]),
                 rng.choice([None, rng.sample(pool, 2)])) for i in ids]
        if k % 2:
            rows = list({r[0]: r for r in rows}.values())
        catalog = spark.createDataFrame(
            rows, "kpi_id string, source_fields array<string>, numerator string, denominator string, aliases array<string>")
        heads = [(rng.choice([None, *range(12)]), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, *pool])) for _ in range(50)]
        asked = [(rng.choice([None, *range(14)]), [f"k{rng.randrange(7)}" for _ in range(rng.randrange(4))]) for _ in range(25)]
        want = []
        for upload, kpis in asked:
            for kpi in sorted({x for x in kpis if x in ids}):
                found = []
                for u, position, header in heads:
                    for _, fields, num, den, aliases in (r for r in rows if r[0] == kpi):
                        if upload is not None and u == upload and header is not None:
                            names = dict.fromkeys(c for c in [*fields, num, den, *(aliases or [])] if c is not None and c != "_none_")
                            score, at = best_candidate(header, [*names])
                            if at >= 0:
                                found.append((score, -99 if position is None else -position, -at, header.encode(), header))
                best = max(found, default=(0.0, 0, 0, b"", None))
                want.append((upload, kpi, best[4], round(best[0], 2), best[0] < 0.7))
        got = mapping.match_headers(
            spark.createDataFrame(heads, "upload_id int, position int, header string"),
            spark.createDataFrame(asked, "upload_id int, kpi_list array<string>"), catalog, settle=settle).collect()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
