"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, itq, jaccard, kdmeans, language, media, mixing, quality, sharding, topk, toxicity, urlfilter, whitening
from .common import crc_fold, table

SHARDS = [f"shard-{i:03d}" for i in range(64)]
SLOTS = 65537


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90, 100)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures: every row of pages, fetched on day page_id mod 360 of 2024. List: a quarter of the hosts are listed, taken off and listed again; example.net and one first path are listed for a while."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 360).cast("int")))
    hosts = captures.select(urlfilter.url_host(F.col("url")).alias("host")).filter("host IS NOT NULL").distinct()
    digit = F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 2), 16, 10).cast("int")
    dated = hosts.withColumn("n", digit).filter("n % 4 = 0").selectExpr("host AS pattern", "explode(array(struct(n AS d, 'block' AS action), struct(n + 40 AS d, 'allow' AS action), struct(n + 90 AS d, 'block' AS action))) AS x")
    fixed = spark.sql("SELECT * FROM VALUES ('example.net', 100, 'block'), ('example.net', 160, 'allow'), ('example.com/fr/', 200, 'block'), ('example.com/fr/', 200, 'allow'), ('example.com/en/', 10, 'block'), ('example.com/en/', 30, 'allow') AS t(pattern, d, action)")
    entries = dated.selectExpr("pattern", "x.d AS d", "x.action AS action").unionByName(fixed).select("pattern", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("listed_at"), "action")
    out = urlfilter.url_filter(captures, entries)
    return out.select("page_id", "host", "blocked", "pattern", F.datediff("since", F.lit("2024-01-01").cast("date")).alias("since_day"))


OP2_SQL = r"""
WITH c AS (SELECT page_id, url, page_id % 360 AS day, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(?:[wW][wW][wW]\.)?([^/?#:@]+)', 1)), '') AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)/', 1) AS first FROM pages),
h AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 2) AS INT) AS n FROM c WHERE host IS NOT NULL),
raw AS (SELECT host AS pattern, n + unnest([0, 40, 90]) AS d, unnest(['block', 'allow', 'block']) AS action FROM h WHERE n % 4 = 0
  UNION ALL SELECT * FROM (VALUES ('example.net', 100, 'block'), ('example.net', 160, 'allow'), ('example.com/fr/', 200, 'block'), ('example.com/fr/', 200, 'allow'), ('example.com/en/', 10, 'block'), ('example.com/en/', 30, 'allow')) v),
e AS (SELECT pattern, d, max(action) AS action FROM raw GROUP BY pattern, d),
i AS (SELECT *, lead(d) OVER (PARTITION BY pattern ORDER BY d) AS until FROM e),
b AS (SELECT * FROM i WHERE action = 'block'),
m AS (SELECT c.page_id, b.pattern, b.d, row_number() OVER (PARTITION BY c.page_id ORDER BY length(b.pattern) DESC, b.pattern, b.d) AS rn
  FROM c JOIN b ON (c.host = split_part(b.pattern, '/', 1) OR ends_with(c.host, '.' || split_part(b.pattern, '/', 1))) AND (b.pattern NOT LIKE '%/' OR split_part(b.pattern, '/', 2) = c.first)
  AND b.d <= c.day AND (b.until IS NULL OR c.day < b.until))
SELECT c.page_id, c.host, m.pattern IS NOT NULL AS blocked, m.pattern, CAST(m.d AS INT) AS since_day FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.rn = 1
"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard, over 64 shards."""
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS).select("doc_id", "slot", "shard")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sizes(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def _classified(df: DataFrame, threshold: float) -> DataFrame:
    return df.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _classified(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", crc_fold("doc_id", 5) != 0)), 0.5)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.label_languages(docs.drop("lang"), language.train(docs, crc_fold("doc_id", 4) != 2), spans=False)
    return out.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _classified(quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"), "quality", crc_fold("doc_id", 5) != 0)), 0.3)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.store_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.95)


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdmeans.clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", dims=64, k=16, rounds=3)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=4)


QUERIES = {"op1_jaccard_join": op1_jaccard_join, "op3_bpe": op3_bpe, "op4_toxicity": op4_toxicity, "op5_language": op5_language, "op6_top_k": op6_top_k, "op8_quality": op8_quality, "op10_media": op10_media}
QUERIES |= {"op2_url_filter": op2_url_filter, "op7_sharding": op7_sharding, "op9_mixing": op9_mixing}
QUERIES |= {"op11_embedding_dedup": op11_embedding_dedup, "op12_clustering": op12_clustering, "op13_whitening": op13_whitening}
SQL = {"op1_jaccard_join": jaccard.components_sql(3, 90, 100), "op2_url_filter": OP2_SQL, "op6_top_k": topk.SQL, "op9_mixing": mixing.PLAN_SQL, "op11_embedding_dedup": itq.links_sql(0.95), "op12_clustering": kdmeans.clusters_sql()}


def sharding_sql() -> str:
    """The filled table is stated as text; tests hold it against a plain fill."""
    slots = ",".join(map(str, sharding.fill(SHARDS, SLOTS)))
    return f"""
WITH t AS (SELECT string_split('{slots}', ',') AS a), d AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(a[slot + 1], 3, '0') AS shard FROM d, t
"""


SQL["op7_sharding"] = sharding_sql()
