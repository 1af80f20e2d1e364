"""The registered query of each operator; SQL for DuckDB where it can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import attention_lm, decontaminate, fertility, langid, line_dedup, packing, quality_em, token_files, trie_join, url_lists
from cohortlake.llm.shared import fresh_path, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_em.classify(docs, quality_em.fit(docs), keep_text=False)


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rated = fertility.rate(docs, pieces_file=public_tokenizers.path("piece_bpe_32k.model"), bytes_file=public_tokenizers.path("byte_bpe_50k.json"))
    return rated.drop("lang")


def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), (~held_out).alias("train"), "text")
    return attention_lm.score(docs, file=public_tokenizers.path("word_bpe_49k.json"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"),
        (decontaminate.n_hit() > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM iw
), dw AS (
  SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k)
), m AS (SELECT doc_id, item_id, p, dw.k FROM dw JOIN iw USING (g)  WHERE dw.k = iw.k
), hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), file=public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, file=public_tokenizers.path("byte_bpe_50k.json"), end=0)
    read = token_files.read_token_files(spark, path)
    return read.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


#: pages has neither fetch times nor lists, so the query makes both from what it has: captures spread
#: over 2024, every host listed for a while and listed again later, every first path segment of a host
#: listed once for good. The dates come from digests of the patterns.
FIRST_DAY = 19723


def _digest(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 6), 16, 10).cast("long")


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.lit(FIRST_DAY * 86400) + F.pmod(F.col("page_id") * 7919, F.lit(366 * 1440)) * 60)
    host, part = url_lists.host(F.col("url")), url_lists.segments(F.col("url"))
    hosts = pages.where(host != "").select(host.alias("pattern")).distinct().withColumn("d", _digest(F.col("pattern")))
    first = FIRST_DAY + F.pmod(F.col("d"), F.lit(200))
    turns = F.array(
        F.struct(first.alias("day"), F.lit(True).alias("listed")),
        F.struct((first + 20 + F.pmod(F.col("d"), F.lit(41))).alias("day"), F.lit(False).alias("listed")),
        F.struct((first + 120).alias("day"), F.lit(True).alias("listed")),
    )
    by_host = hosts.select(F.lit("hosts").alias("list"), "pattern", F.explode(turns).alias("t")).select("list", "pattern", "t.day", "t.listed")
    paths = pages.where((host != "") & (F.size(part) > 0)).select(F.concat(host, F.lit("/"), F.get(part, F.lit(0))).alias("pattern")).distinct()
    by_path = paths.select(F.lit("paths").alias("list"), "pattern", (FIRST_DAY + F.pmod(_digest(F.col("pattern")), F.lit(366))).alias("day"), F.lit(True).alias("listed"))
    return url_lists.match(captures, by_host.unionByName(by_path))


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, url, 19723 * 86400 + (page_id * 7919) % (366 * 1440) * 60 AS fetched_at,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS segs
  FROM pages
), h AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS BIGINT) AS d FROM (SELECT DISTINCT host AS pattern FROM p WHERE host <> '')
), s AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS BIGINT) AS d FROM (SELECT DISTINCT host || '/' || segs[1] AS pattern FROM p WHERE host <> '' AND len(segs) > 0)
), e AS (
  SELECT DISTINCT list, lower(pattern) AS pattern, day, listed FROM (
    SELECT 'hosts' AS list, pattern, 19723 + d % 200 AS day, true AS listed FROM h
    UNION ALL SELECT 'hosts', pattern, 19723 + d % 200 + 20 + d % 41, false FROM h
    UNION ALL SELECT 'hosts', pattern, 19723 + d % 200 + 120, true FROM h
    UNION ALL SELECT 'paths', pattern, 19723 + d % 366, true FROM s)
), iv AS (
  SELECT list, pattern, day * 86400 AS a, nxt * 86400 AS b
  FROM (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day, listed) AS nxt FROM e) WHERE listed AND (nxt IS NULL OR nxt > day)
), lab AS (SELECT *, string_split(host, '.') AS l FROM p WHERE host <> ''
), dom AS (
  SELECT page_id, url, fetched_at, segs, array_to_string(l[i:], '.') AS d FROM (SELECT *, unnest(range(1, greatest(len(l), 2))) AS i FROM lab WHERE NOT regexp_matches(host, '^\d+(\.\d+){3}$'))
  UNION ALL SELECT page_id, url, fetched_at, segs, host FROM lab WHERE regexp_matches(host, '^\d+(\.\d+){3}$')
), c AS (
  SELECT page_id, url, fetched_at, d AS pattern FROM dom UNION ALL SELECT page_id, url, fetched_at, d || '/' || segs[1] FROM dom WHERE len(segs) > 0
), m AS (
  SELECT page_id, url, fetched_at, count(DISTINCT list || ' ' || pattern) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, first(pattern ORDER BY length(pattern) DESC, pattern) AS pattern
  FROM c JOIN iv USING (pattern) WHERE fetched_at >= a AND (b IS NULL OR fetched_at < b) GROUP BY ALL
)
SELECT p.page_id, p.url, CAST(p.fetched_at AS BIGINT) AS fetched_at, CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(lists, '') AS lists, m.pattern, coalesce(n, 0) > 0 AS blocked
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.url IS NOT DISTINCT FROM p.url AND m.fetched_at = p.fetched_at
"""


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_gone_lines", "n_line_words", "n_gone_words", F.length("text").cast("long").alias("n_chars_left"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))


def op10_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.similar_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality": op1_quality, "op2_fertility": op2_fertility, "op3_attention_lm": op3_attention_lm, "op4_decontaminate": op4_decontaminate, "op5_packing": op5_packing, "op6_token_files": op6_token_files, "op7_url_lists": op7_url_lists, "op8_langid": op8_langid, "op9_line_dedup": op9_line_dedup, "op10_trie_join": op10_trie_join}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": OP4_SQL, "op7_url_lists": OP7_SQL}
