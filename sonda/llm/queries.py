"""The thin queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, jaccard, packing, quality, secrets, shards, token_counts, token_files, url_filters


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)
    return files.read(spark).withColumnRenamed("id", "doc_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return got.withColumn("over_limit", F.col("n_tokens") > 512)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = quality.scored(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), with_ids=False)
    return got.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


FIRST_DAY = "2024-01-01"


def listed(pages: DataFrame) -> DataFrame:
    """Dated entries made from the hosts of ``pages`` by a rule: md5 says which are listed, and on which days.

    A quarter of the domains of three labels is added, removed again, and added again; an eighth of the hosts is added.
    """
    hosts = pages.select(url_filters.host(F.col("url")).alias("h")).where("h is not null").distinct()

    def number(name, at):
        return F.conv(F.substring(F.md5(name), at, 2), 16, 10).cast("int")

    d = hosts.select(F.substring_index("h", ".", -3).alias("domain")).distinct().where(F.substring(F.md5("domain"), 1, 1).isin(*"0123"))
    d = d.withColumn("a", number(F.col("domain"), 2)).withColumn("b", number(F.col("domain"), 4) % 90 + 1)
    d = d.select("domain", F.inline(F.array(F.struct(F.lit("add").alias("action"), F.col("a").alias("n")), F.struct(F.lit("remove").alias("action"), (F.col("a") + F.col("b")).alias("n")), F.struct(F.lit("add").alias("action"), (F.col("a") + F.col("b") + 30).alias("n")))))
    h = hosts.select(F.col("h").alias("domain"), F.lit("add").alias("action"), number(F.col("h"), 2).alias("n")).where(F.substring(F.md5("domain"), 1, 1).isin(*"45"))
    return d.unionByName(h).select("domain", "action", F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("n")).alias("day"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("page_id") % 366).cast("int")))
    got = url_filters.judged(captures, listed(pages))
    return got.select("page_id", "host", F.col("fetched_on").cast("string").alias("fetched_on"), "n_active", "entry", F.col("active_since").cast("string").alias("active_since"), "blocked")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = secrets.spans(docs, secrets.fitted(docs))

    def joined(s):
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return got.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shards.assign(table(spark, sf_dir, "documents"), 24)
    return got.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long")
    return got.select("doc_id", "n_words", decontaminate.n_hit("hits").alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_fingerprints, op2_token_files, op3_token_counts, op4_quality, op5_jaccard_join, op6_packing, op7_url_filters, op8_secrets, op9_sharding, op10_decontamination)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op5_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * i >= 4 * (nx.n + ny.n - i)),
r AS (SELECT x AS node, x AS reached FROM l UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.reached),
c AS (SELECT node, min(reached) AS class_id FROM r GROUP BY node),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(k.n_links, 0) AS n_links
FROM documents d LEFT JOIN c ON c.node = d.doc_id LEFT JOIN k ON k.x = d.doc_id
""",
    "op7_url_filters": r"""
WITH h AS (
  SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)', 1), '') AS raw, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS d
  FROM pages),
c AS (SELECT page_id, d, regexp_replace(raw, '\.$', '') AS host FROM h),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS p FROM c WHERE host IS NOT NULL),
dom AS (SELECT DISTINCT array_to_string(p[greatest(len(p) - 2, 1):], '.') AS domain FROM hosts),
dn AS (SELECT domain, CAST('0x' || substr(md5(domain), 2, 2) AS INTEGER) AS a, CAST('0x' || substr(md5(domain), 4, 2) AS INTEGER) % 90 + 1 AS b
       FROM dom WHERE substr(md5(domain), 1, 1) IN ('0', '1', '2', '3')),
e AS (
  SELECT domain, 'add' AS action, a AS n FROM dn UNION ALL SELECT domain, 'remove', a + b FROM dn UNION ALL SELECT domain, 'add', a + b + 30 FROM dn
  UNION ALL SELECT host, 'add', CAST('0x' || substr(md5(host), 2, 2) AS INTEGER) FROM hosts WHERE substr(md5(host), 1, 1) IN ('4', '5')),
e1 AS (SELECT domain, DATE '2024-01-01' + n AS day, max(action) AS action FROM e GROUP BY ALL),
e2 AS (SELECT *, lag(action) OVER (PARTITION BY domain ORDER BY day) AS before FROM e1),
e3 AS (SELECT domain, day, action, lead(day) OVER (PARTITION BY domain ORDER BY day) AS until FROM e2 WHERE action <> coalesce(before, 'remove')),
spans AS (SELECT domain, day AS since, until FROM e3 WHERE action = 'add'),
keys AS (SELECT page_id, c.d, unnest(list_transform(range(1, len(string_split(c.host, '.')) + 1), lambda i: array_to_string(string_split(c.host, '.')[i:], '.'))) AS domain
         FROM c WHERE host IS NOT NULL),
active AS (SELECT page_id, domain, since FROM keys JOIN spans USING (domain) WHERE since <= d AND (until IS NULL OR d < until)),
best AS (SELECT page_id, count(*) AS n, max_by(struct_pack(domain := domain, since := since), struct_pack(l := length(domain), domain := domain)) AS e FROM active GROUP BY page_id)
SELECT c.page_id, c.host, CAST(c.d AS VARCHAR) AS fetched_on, coalesce(n, 0) AS n_active, e.domain AS entry, CAST(e.since AS VARCHAR) AS active_since, n IS NOT NULL AS blocked
FROM c LEFT JOIN best USING (page_id)
""",
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(8, len(ws)) AS k, unnest(list_transform(range(1, greatest(len(ws) - 6, 2)), lambda x: array_to_string(ws[x:x + 7], ' '))) AS win FROM b WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS i, ws FROM d, ks WHERE len(ws) >= k),
hit AS (SELECT doc_id, dw.k, i, item_id FROM (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win FROM dw) dw JOIN bw ON bw.k = dw.k AND bw.win = dw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
""",
}
