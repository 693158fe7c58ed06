"""The registered queries of the corpus operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, licenses, mix, pack, quality, sharding, simhash, tokens, topk, urls, warc

#: Bytes of text that a shard of op3 holds at most.
SHARD_BYTES = 1 << 20
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: op10 blocks a host when its rate of bad pages is over this with the confidence of z deviations.
MAX_BAD, Z = 0.5, 1.645
#: op9 rejects a host when the shrunken failure rate of a rule is over this.
MAX_RATE = 0.6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    found = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write_token_files(table(spark, sf_dir, "documents"), common.fresh_dir(spark, "tokens"))
    return tokens.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES).select("doc_id", "n_bytes", "shard", "shard_bytes")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix.taken_words(docs).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), common.fresh_dir(spark, "warc"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    stats = common.written(quality.with_stats(docs, ["doc_id", "source"]), "quality-stats")
    return quality.judged_rows(stats, "source", MAX_RATE).select("row.doc_id", "stats.*", "base_failed", "kept")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    # labels has no page_id; ids of documents stand for the pages of the same number, so some pages have outcomes.
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, outcomes, URL_RULES, MAX_BAD, Z).select("page_id", "host", "path", "rule", "verdict")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_topk, op2_token_files, op3_sharding, op4_mix, op5_packing, op6_warc, op7_simhash, op8_licenses, op9_quality, op10_urls, pipeline)
    return {f.__name__: f for f in own}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1]::HUGEINT * p[2]::HUGEINT)), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id IS DISTINCT FROM c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
), p AS (
  SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes)::BIGINT AS bytes FROM d, range(0, 41) t(depth) GROUP BY ALL
), leaf AS (
  SELECT p.depth, p.prefix, p.bytes FROM p LEFT JOIN p up ON up.depth = p.depth - 1 AND up.prefix = p.prefix >> 1
  WHERE p.bytes <= {SHARD_BYTES} AND (p.depth = 0 OR up.bytes > {SHARD_BYTES})
)
SELECT doc_id, n_bytes, CASE WHEN leaf.depth = 0 THEN '' ELSE lpad(bin(leaf.prefix), leaf.depth::INT, '0') END AS shard, bytes AS shard_bytes
FROM d JOIN leaf ON leaf.prefix = d.h >> (60 - leaf.depth)
"""

OP6_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def op9_sql() -> str:
    rules = ("few_words", "repeats", "symbols", "word_length")
    rates = ",\n".join(
        f"""  {r} AS (
    SELECT m, CASE WHEN between_ <= 0 THEN 1000 ELSE least(1000, greatest(1, m * (1 - m) / between_ - 1)) END AS k FROM (
      SELECT m, CASE WHEN spread > free THEN (squares - free * m * (1 - m)) / (spread - free) ELSE 0 END AS between_ FROM (
        SELECT sum({r}) / sum(n)::DOUBLE AS m, sum({r} * {r}::DOUBLE / n) - sum(n) * (sum({r}) / sum(n)::DOUBLE) ** 2 AS squares,
          count(*) - 1 AS free, sum(n) - sum(n * n::DOUBLE) / sum(n) AS spread FROM hosts)))""".replace(f"  {r} AS", f"  prior_{r} AS", 1)
        for r in rules
    )
    bad = " OR ".join(f"(hosts.{r} + prior_{r}.m * prior_{r}.k) / (n + prior_{r}.k) > {MAX_RATE}" for r in rules)
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS c
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)
), rep AS (
  SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY rid
), s AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w) LEFT JOIN rep USING (rid)
), j AS (
  SELECT *, n_words < 50 AS few_words, 100 * n_repeat_words > 50 * n_words AS repeats, 10 * n_symbols > n_words AS symbols,
    word_chars < 2 * n_words OR word_chars > 15 * n_words AS word_length FROM s
), hosts AS (
  SELECT source, count(*) AS n, {", ".join(f"sum({r}::BIGINT)::BIGINT AS {r}" for r in rules)} FROM j GROUP BY source
),
{rates}, verdict AS (
  SELECT source, {bad} AS bad FROM hosts, {", ".join(f"prior_{r}" for r in rules)}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeats AS base_failed, NOT (few_words OR repeats) AND NOT bad AS kept
FROM j JOIN verdict ON j.source IS NOT DISTINCT FROM verdict.source
"""


def op10_sql() -> str:
    def prior(name: str, units: str) -> str:
        return f"""  {name} AS (
    SELECT CASE WHEN coalesce(between_, 0) <= 0 THEN 1000 ELSE least(1000, greatest(1, m * (1 - m) / between_ - 1)) END AS k FROM (
      SELECT m, CASE WHEN spread > free THEN (squares - free * m * (1 - m)) / (spread - free) ELSE 0 END AS between_ FROM (
        SELECT any_value(m) AS m, sum(bad::DOUBLE * bad / n) - sum(n) * any_value(m) * any_value(m) AS squares, count(*) - 1 AS free, sum(n) - sum(n::DOUBLE * n) / sum(n) AS spread
        FROM {units}, mean WHERE n > 0)))"""

    cases = sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = lambda text: f"(host = '{text.partition('/')[0]}' OR ends_with(host, '.{text.partition('/')[0]}')) AND starts_with(path, '/{text.partition('/')[2]}')"
    rule = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in cases) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{v}'" for v, t in cases) + " END"
    deep = rf"regexp_matches(host, '\.({'|'.join(urls.SECOND_LEVEL)})\.[a-z][a-z]$')"
    return f"""
WITH r AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), l AS (SELECT doc_id, quality = 0 OR toxic = 1 AS bad FROM labels),
hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad::INT), 0)::BIGINT AS bad, array_to_string(string_split(host, '.')[(CASE WHEN {deep} THEN -3 ELSE -2 END):], '.') AS domain,
    array_to_string(string_split(host, '.')[(CASE WHEN {deep} THEN -2 ELSE -1 END):], '.') AS suffix
  FROM u LEFT JOIN l ON l.doc_id = u.page_id GROUP BY host
), domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY ALL),
mean AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0)::DOUBLE, 0) AS m FROM hosts),
{prior("k3", "suffixes")},
{prior("k2", "domains")},
{prior("k1", "hosts")},
rated AS (
  SELECT host, hosts.n, k1.k AS k, (hosts.bad + k1.k * (domains.bad + k2.k * (suffixes.bad + k3.k * m) / (suffixes.n + k3.k)) / (domains.n + k2.k)) / (hosts.n + k1.k) AS rate
  FROM hosts JOIN domains USING (domain) JOIN suffixes ON suffixes.suffix = domains.suffix, mean, k1, k2, k3
), judged AS (SELECT host, rate - {Z} * sqrt(rate * (1 - rate) / (n + k + 1)) > {MAX_BAD} AS blocked FROM rated)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN judged USING (host)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1_SQL, "op3_sharding": OP3_SQL, "op6_warc": OP6_SQL, "op9_quality": op9_sql(), "op10_urls": op10_sql()}
