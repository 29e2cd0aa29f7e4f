"""One query per operator over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywise.llm import bpe, chat, clusters, decontam, exact, langid, quality, runs, shards, simhash, suffix, toxicity, urls
from tallywise.llm.common import table

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def wrap(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


@query("op1_chat_snapshots", """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS body FROM conversations),
n AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body) - 1 AS place,
         '<|' || role || '|>' || chr(10) || body || '<|end|>' || chr(10) AS piece FROM t),
p AS (
  SELECT conv_id, place, piece, md5(string_agg(length(piece) || ':' || piece, '' ORDER BY place)
         OVER (PARTITION BY conv_id ORDER BY place)) AS prefix FROM n),
e AS (SELECT conv_id, count(*) AS n_turns, arg_max(prefix, place) AS last FROM p GROUP BY conv_id),
k AS (
  SELECT min(conv_id) AS conv_id, n_turns, last FROM e
  WHERE NOT EXISTS (SELECT 1 FROM p JOIN e AS o ON p.conv_id = o.conv_id
                    WHERE p.prefix = e.last AND p.place + 1 = e.n_turns AND o.n_turns > e.n_turns)
  GROUP BY n_turns, last)
SELECT n.conv_id, place // 512 AS part, n_turns, min(place) AS first_place, count(*) AS turns_in_part,
       string_agg(piece, '' ORDER BY place) AS rendered
FROM n JOIN k ON n.conv_id = k.conv_id GROUP BY n.conv_id, place // 512, n_turns""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark, table(spark, sf_dir, "conversations"))


@query("op2_exact_dedup", r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(spark, table(spark, sf_dir, "documents"))


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(spark, table(spark, sf_dir, "documents"), words=3, lanes=1, radius=2)


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_digests(bpe.round_trip(spark, table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def token_digests(tokens: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                         F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_byte_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign_shards(spark, table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.keep_digests(suffix.repeated_bytes(spark, table(spark, sf_dir, "documents")))


@query("op6_subword_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_decontaminate")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# fixed values
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op11_url_cascade", f"""
WITH r(rule_host, rule_path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, row_number() OVER () AS n, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM p),
f AS (
  SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (n)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(spark, table(spark, sf_dir, "pages"), rules)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which every tenth document (by checksum of its id) repeats words from some place on."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    g, n = F.floor(F.col("h") / 10), F.col("n")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    marked = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    chosen = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    marked = marked.withColumn("words", F.when(chosen, words)).withColumn("n", F.size("words").cast("long"))
    planted = marked.select("doc_id", "text", "words", F.when(F.col("n") > 0, F.struct(
        n.alias("n"), a.cast("int").alias("a"), p.cast("int").alias("p"))).alias("s"))
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("s.a") + 1, F.col("s.p")),
                                    F.ceil((F.col("s.n") - F.col("s.a")) / F.col("s.p")).cast("int")))
    whole = F.concat(F.slice("words", F.lit(1), F.col("s.a")), F.slice(tail, F.lit(1), (F.col("s.n") - F.col("s.a")).cast("int")))
    return planted.select("doc_id", F.when(F.col("s").isNotNull(), F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_word_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.find_runs(spark, with_planted_runs(table(spark, sf_dir, "documents"))))


def cluster_sql(rounds: int) -> str:
    parts = ["""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j, vec AS centre
  FROM v QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= 16)"""]
    for t in range(rounds + 1):
        parts.append(f"""
a{t} AS (
  SELECT vec_id, any_value(vec) AS vec, min({{'d': d, 'j': j}}) AS best
  FROM (SELECT vec_id, vec, j, CAST(list_sum(list_transform(list_zip(vec, centre), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM v CROSS JOIN c{t}) GROUP BY vec_id)""")
        if t < rounds:
            means = ", ".join(f"CAST(floor(sum(vec[{i}]) / CAST(count(*) AS DOUBLE)) AS BIGINT)" for i in range(1, 65))
            parts.append(f"""
m{t} AS (SELECT best.j AS j, [{means}] AS centre FROM a{t} GROUP BY best.j),
c{t + 1} AS (SELECT c{t}.j, coalesce(m{t}.centre, c{t}.centre) AS centre FROM c{t} LEFT JOIN m{t} USING (j))""")
    return ",".join(parts) + f"""
SELECT vec_id, CAST(best.j AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(centre, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best.j = c{rounds}.j"""


@query("op13_ns_clusters", cluster_sql(clusters.ROUNDS))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_digests(*clusters.cluster_vectors(spark, table(spark, sf_dir, "embeddings")))
