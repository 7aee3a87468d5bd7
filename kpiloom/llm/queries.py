"""The operators' queries over whole tables, and their DuckDB checks where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm import (
    clustering, conversations, licenses, mixing, packing, quality_classifier, quality_rules, secrets, sharding, simhash,
    substring_dedup, topk, url_filter,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

RULES = (
    url_filter.Rule("org", "/", "allow"), url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"), url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in training order with the words the mix takes of each."""
    plan = mixing.assign(_table(spark, sf_dir, "documents"))
    first = F.array_min(F.transform("placements", lambda p: p["position"]))
    return mixing.in_training_order(plan.withColumn("position", first), F.col("position")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "position")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    rows = sharding.shard(_table(spark, sf_dir, "documents"), n_shards=40, overhead=16)
    return rows.select(
        "doc_id", F.col("shard_bytes").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", F.col("shard_slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that windows of 50 repeat from a document with a smaller id."""
    return substring_dedup.digest(_table(spark, sf_dir, "documents"), window=50)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document by rules learnt from the labels."""
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return simhash.classes(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth one."""
    return topk.search(_table(spark, sf_dir, "embeddings"), query_step=50, k=5)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page: the rules, else the list of pages whose document is marked toxic."""
    pages = _table(spark, sf_dir, "pages")
    toxic = _table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id")).distinct()
    listed = pages.join(toxic, "page_id", "left_semi").select("url")
    return url_filter.judge(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens packed into windows of up to 2048."""
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "tier", "step_group")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    rows = secrets.scan(_table(spark, sf_dir, "documents")).select("doc_id", "secret_spans")

    def count(kind: str):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secret_spans", lambda s: s["kind"] != "entropy")
    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.col("secret_spans")).alias("spans"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document by counts and by likeness to documents labelled good and not toxic."""
    trusted = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return quality_rules.judge(_table(spark, sf_dir, "documents"), trusted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices of every document."""
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "expressions")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with every conversation after damage, and its cheapest repair."""
    return conversations.digest(_table(spark, sf_dir, "conversations"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after three rounds of 16 centroids."""
    return clustering.cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, dims=64, seed=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mixing, op2_sharding, op3_substring_dedup, op4_quality_classifier, op5_simhash, op6_topk,
        op7_url_filter, op8_packing, op9_secrets, op10_quality_rules, op11_licenses, op12_conversations,
        op13_clustering)
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1)"

_CENTROIDS = 16


def _assigned(n: int) -> str:
    """a<n>: every vector's nearest centroid of c<n>; distance and number in one integer, so the least has both."""
    return f"""
        a{n} AS (SELECT i, CAST(min(d * {_CENTROIDS} + c) % {_CENTROIDS} AS INTEGER) AS c, CAST(min(d * {_CENTROIDS} + c) // {_CENTROIDS} AS BIGINT) AS d
                FROM (SELECT v.i, c.c, CAST(list_sum(list_transform(list_zip(v.e, c.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
                      FROM v CROSS JOIN c{n} c) GROUP BY i)"""


def _moved(n: int) -> str:
    """c<n + 1>: the floor of the mean of each centroid's vectors, or where it was."""
    return f"""
        s{n} AS (SELECT c, p, CAST(sum(e[p]) AS BIGINT) AS s, count(*) AS n
                FROM a{n} JOIN v USING (i) CROSS JOIN (SELECT unnest(range(1, 65)) AS p) GROUP BY c, p),
        m{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS m FROM s{n} GROUP BY c),
        c{n + 1} AS (SELECT c{n}.c, coalesce(m{n}.m, c{n}.m) AS m FROM c{n} LEFT JOIN m{n} USING (c))"""


CHECKS: dict[str, str] = {
    "op13_clustering": f"""
        WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                   FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64
                     AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS INTEGER) AS c, e AS m FROM v
               ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), e LIMIT {_CENTROIDS}),
        {", ".join(_assigned(n) + "," + _moved(n) for n in range(3))}, {_assigned(3)},
        t AS (SELECT c, CAST(sum(d) AS BIGINT) AS own FROM a3 GROUP BY c)
        SELECT v.vec_id, a3.c AS cluster, a3.d AS distance, t.own AS cluster_inertia, (SELECT CAST(sum(own) AS BIGINT) FROM t) AS inertia,
               sha256(array_to_string(c3.m, ',')) AS centroid_sha256
        FROM a3 JOIN v USING (i) JOIN t USING (c) JOIN c3 USING (c)""",
    "op3_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
              FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
        f AS (SELECT h, min(doc_id) AS least FROM w GROUP BY h),
        hit AS (SELECT w.doc_id, w.i FROM w JOIN f USING (h) WHERE f.least < w.doc_id),
        gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS at FROM hit GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(g.at), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN g.at IS NULL THEN ws ELSE
                   [x.w FOR x IN list_transform(ws, lambda w, i: {{'w': w, 'i': i}}) IF NOT list_contains(g.at, x.i)] END, ' ')) AS kept_sha256
        FROM d LEFT JOIN gone g USING (doc_id)""",
    "op6_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                   FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id,
                     CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5""",
    "op7_url_filter": f"""
        WITH p AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path, {_HOST} || regexp_replace({_PATH}, '/$', '') AS place,
                          array_to_string(list_filter(string_split({_QUERY}, '&'), lambda q: q <> '' AND NOT starts_with(q, 'utm_')), '&') AS query
                   FROM pages),
        c AS (SELECT *, CASE WHEN contains(url, '://') THEN place || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canon FROM p),
        l AS (SELECT DISTINCT canon FROM c WHERE canon IS NOT NULL
              AND page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
        r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
            ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        b AS (SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rverdict, length(rhost || rpath)) AS rverdict
              FROM c JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
        SELECT c.page_id, host, path, rule,
               CASE WHEN rule IS NOT NULL THEN rverdict WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
        FROM c LEFT JOIN b USING (page_id) LEFT JOIN l ON c.canon = l.canon""",
}
