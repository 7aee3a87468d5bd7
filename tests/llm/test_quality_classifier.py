import zlib

from pyspark.sql import functions as F

from kpiloom.llm import quality_classifier as qc
from kpiloom.llm import queries
from tests.llm.conftest import edge_texts


def test_paths_of_a_printed_forest():
    text = """RandomForestClassificationModel: uid=x, numTrees=2
  Tree 0 (weight 1.0):
    If (feature 3 <= 0.5)
     If (feature 1 <= 1.0E-4)
      Predict: 0.0
     Else (feature 1 > 1.0E-4)
      Predict: 1.0
    Else (feature 3 > 0.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    Predict: 1.0
"""
    assert [r.conditions for r in qc.tree_rules(text)] == [
        ((3, True, 0.5),), ((3, True, 0.5), (1, True, 1e-4)), ((3, True, 0.5), (1, False, 1e-4)), ((3, False, 0.5),)]


def test_held_out_accuracy(spark):
    rows = queries.op4_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    judged = [(quality[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in quality]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)
    assert sum(b for a, b in judged if a) >= 0.97 * sum(a for a, _ in judged)


def test_edge_cases(spark, edge_docs, clashing_docs, empty_docs):
    labels = edge_docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    labels = labels.union(spark.createDataFrame([(None, 1), (5, None), (999, 1)], "doc_id long, quality int"))
    for frame in (edge_docs, clashing_docs):
        rows = qc.classify(frame, labels).collect()
        assert len(rows) == frame.count() == len(edge_texts()) + 1
        assert all(0 <= r["score"] <= 1 for r in rows)
    kept = qc.keep_good(clashing_docs, labels, threshold=0.0)
    assert kept.columns == clashing_docs.columns and kept.count() == clashing_docs.count()
    assert {r["score"] for r in qc.classify(edge_docs, labels.limit(0)).collect()} == {0.5}
    assert qc.classify(edge_docs, labels.where("quality = 1")).where("score > 0.5 and score < 1").count() == edge_docs.count()
    assert qc.classify(empty_docs, labels).count() == 0


def test_rules_only_read_the_text(spark, edge_docs):
    labels = edge_docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    a = qc.with_statistics(edge_docs).orderBy("doc_id").collect()
    b = qc.with_statistics(edge_docs.withColumns({"lang": F.lit("q"), "source": F.lit("q")})).orderBy("doc_id").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b] and labels.count()
