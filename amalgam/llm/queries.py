"""One query for each operator, over its whole table, with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, lm, mixing, pii, quality, sharding, simhash, suffix, tokenout, urls

SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by jump hash of doc_id."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.assign_shards(rows, SHARDS).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The rules that the URL query applies.
URL_RULES = [urls.Rule("block", "com/en/"), urls.Rule("allow", "example.com/en/7"), urls.Rule("allow", "net/de/"), urls.Rule("block", "example.net/de/8"), urls.Rule("block", "org/es/")]


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url. The urls that a rule fits are the labelled ones that the trees learn from."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = urls.fit(urls.apply_rules(pages, URL_RULES).withColumnRenamed("rule_verdict", "verdict"))
    return urls.judge(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "p_block")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of six sevenths of them."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    scored = lm.score(table(spark, sf_dir, "documents"), F.when(held_out, lm.TEST).otherwise(lm.TRAIN))
    return scored.select("doc_id", (F.col("kind") == lm.TEST).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and its distance."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as Simple-8b files in doc_id order and read back."""
    return tokenout.tokenize(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that 50-byte strings of earlier documents cover."""
    return suffix.digest(suffix.repeated_strings(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, most=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with their texts, mixed to weights that are square roots of the sources' shares, over as many rows as there are documents."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), temperature=0.5, seed=7)
    return mixed.select("doc_id", "source", F.round("rate", 9).alias("rate"), "copy", "shuffle_key", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; the classifier learns from labels."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(documents, table(spark, sf_dir, "labels"))
    return quality.judge(documents, model).drop("text")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every document."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_urls": op2_urls,
    "op3_lm": op3_lm,
    "op4_decontam": op4_decontam,
    "op5_tokens": op5_tokens,
    "op6_suffix": op6_suffix,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
}

#: DuckDB SQL of those queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op6_suffix": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT doc_id, i, CASE WHEN i > lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM c)),
r AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, span),
k AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept, sum(b - a) AS n_removed, count(*) AS n_spans
      FROM (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r) JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op8_mixing": """
WITH s AS (SELECT source, count(*) AS n, sqrt(count(*)) AS raw FROM documents GROUP BY source),
r AS (SELECT source, raw / sum(raw) OVER () * sum(n) OVER () / n AS rate FROM s),
u AS (SELECT d.doc_id, d.source, strlen(d.text) AS n_bytes, md5(d.text) AS text_md5, r.rate, ('0x' || substr(md5('7:' || d.doc_id || ':1'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
      FROM documents d JOIN r ON d.source = r.source),
c AS (SELECT *, len(list_filter(range(0, CAST(ceil(rate + 10 * sqrt(rate) + 30) AS BIGINT) + 1),
        lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-rate + j * ln(rate) - lgamma(j + 1)))) <= u)) AS copies FROM u),
e AS (SELECT doc_id, source, rate, n_bytes, text_md5, unnest(range(1, copies + 1)) AS copy FROM c)
SELECT doc_id, source, round(rate, 9) AS rate, CAST(copy AS INTEGER) AS copy, ('0x' || substr(md5('shuffle:7:' || doc_id || ':' || copy), 1, 12))::BIGINT AS shuffle_key, n_bytes, text_md5 FROM e""",
}
