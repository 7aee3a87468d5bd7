import corpus_pipeline
from kpiloom.llm import queries, quality_classifier, secrets
from tests.llm.test_mixing import expected_targets
from tests.llm.test_near_copies import slow_kept
from tests.llm.test_packing import slow_ids

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "secret_scans", "source_mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    good = stage["quality_classifier"](spark, docs, SF).cache()
    assert good.columns == docs.columns
    scores = {r["doc_id"]: r["predicted"] for r in quality_classifier.classify(docs, labels).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, p in scores.items() if p}

    unique = stage["simhash_near_dedup"](spark, good, SF).cache()
    assert unique.columns == docs.columns
    assert sorted(r["doc_id"] for r in unique.collect()) == slow_kept([(r["doc_id"], r["text"]) for r in good.collect()])

    masked = stage["secret_scans"](spark, unique, SF).cache()
    assert masked.columns == docs.columns and masked.count() == unique.count()
    for r in masked.collect():
        assert r["n_chars"] == len(r["text"])
        assert ("[SECRET]" in r["text"]) or r["text"] == texts[r["doc_id"]]
    assert secrets.scan(masked).where("size(secret_spans) > 0").count() == 0

    mixed = stage["source_mixing"](spark, masked, SF).cache()
    assert mixed.columns == docs.columns
    sizes, taken = {}, {}
    for r in masked.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].encode().split())
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].encode().split())
    for s, target in expected_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= 1

    packed = stage["packing"](spark, mixed, SF).collect()
    assert sum(r["length"] for r in packed) == sum(len(slow_ids(r["text"])) for r in mixed.collect())


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert set(queries.QUERIES) <= set(entry.queries())
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0
