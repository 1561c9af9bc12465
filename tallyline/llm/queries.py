"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import bpe, decontamination, filter_audit, fingerprints, infill, licenses, quality, shards, simhash, substrings, token_files, tokens, warc
from tallyline.llm.frames import fresh_path, small_batches

SUM_TABLE = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TABLE, END = "word_bpe_49k.json", 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_table(name: str = SUM_TABLE) -> tokens.CountTable:
    import public_tokenizers

    return tokens.CountTable(public_tokenizers.path(name), public_tokenizers.PATTERN)


def rank_table(name: str = RANKS) -> bpe.RankTable:
    import public_tokenizers

    return bpe.RankTable(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, count_table()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(_table(spark, sf_dir, "documents"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_finds(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = rank_table()
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(bpe.decode(bpe.encode(docs, ranks), ranks))


def digests(coded: DataFrame) -> DataFrame:
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("data"), 256).alias("decoded_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")[0]).alias("fingerprint"), "component_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def word_encoder(name: str = WORD_TABLE) -> token_files.WordEncoder:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return token_files.WordEncoder(f.read())


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, word_encoder(), end=END)
    read = token_files.tokens_of(spark, path)
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", token_files.ids_crc32(F.col("ids")).alias("ids_crc32"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    back = infill.restored(F.col("output"), F.col("form"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: The same in SQL, where it can be said: trees, merges, gear and XXH64 hashes and alignments can't, and are held against brute force in tests.
_OP4 = """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to FROM p LEFT JOIN f USING (payload_digest)"""

_OP6 = """WITH steps AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, steps),
leaf AS (SELECT n AS s, CASE WHEN n < 24 THEN 'region' || (n // 8) ELSE 'region+' || n END AS region,
    CASE WHEN n < 24 THEN 'region' || (n // 8) || '/rack' || (n // 4 % 2) ELSE 'region+' || n || '/rack0' END AS rack FROM range(25) r(n)),
size_of AS (SELECT * FROM (VALUES (24), (25)) v(n)),
nodes AS (SELECT DISTINCT n, 1 AS level, '' AS parent, region AS name, CAST(count(*) OVER (PARTITION BY n, region) AS DOUBLE) AS w FROM leaf, size_of WHERE s < n
  UNION SELECT DISTINCT n, 2, region, rack, CAST(count(*) OVER (PARTITION BY n, rack) AS DOUBLE) FROM leaf, size_of WHERE s < n
  UNION SELECT n, 3, rack, rack || '/shard' || s, 1.0 FROM leaf, size_of WHERE s < n),
drawn AS (SELECT doc_id, n, level, parent, name, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || name), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / w AS draw FROM d, nodes),
l1 AS (SELECT doc_id, n, arg_min(name, draw) AS name FROM drawn WHERE level = 1 GROUP BY ALL),
l2 AS (SELECT x.doc_id, x.n, arg_min(x.name, draw) AS name FROM drawn x JOIN l1 ON x.doc_id = l1.doc_id AND x.n = l1.n AND x.parent = l1.name WHERE level = 2 GROUP BY ALL),
l3 AS (SELECT x.doc_id, x.n, arg_min(x.name, draw) AS name FROM drawn x JOIN l2 ON x.doc_id = l2.doc_id AND x.n = l2.n AND x.parent = l2.name WHERE level = 3 GROUP BY ALL),
placed AS (SELECT doc_id, n, CAST(split_part(name, '/shard', 2) AS INTEGER) AS shard FROM l3)
SELECT d.doc_id, size, text_crc32, 'key' AS law, a.shard AS shard, row_number() OVER (PARTITION BY a.shard ORDER BY d.doc_id) - 1 AS slot, b.shard AS grown_shard
FROM d JOIN placed a ON d.doc_id = a.doc_id AND a.n = 24 JOIN placed b ON d.doc_id = b.doc_id AND b.n = 25"""

_OP10 = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
firsts AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM win JOIN firsts USING (s), (SELECT unnest(range(0, 13)) AS k) WHERE f < doc_id),
per AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(js, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN per USING (doc_id)"""

_OP12 = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
g AS (SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y, CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""

_OP13 = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents),
firsts AS (SELECT t, min(doc_id) AS f FROM d GROUP BY t),
l AS (SELECT doc_id, max(quality) AS good, max(toxic) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT d.doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > f, false)] AS bad,
    coalesce(good = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic FROM d JOIN firsts USING (t) LEFT JOIN l ON d.doc_id = l.doc_id),
cells AS (SELECT part, bad, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, bad),
x AS (SELECT unnest(range(1, 6)) AS i),
perms AS (SELECT [a.i, b.i, c.i, e.i, g.i] AS p FROM x a, x b, x c, x e, x g WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
placed AS (SELECT part, p, n, good, toxic, bad, s.i AS step, bad[p[s.i]] AS fails, coalesce(list_bool_or(list_transform(p[1:s.i - 1], lambda k: bad[k])), false) AS earlier, len(list_filter(bad, lambda v: v)) AS failed FROM cells, perms, x s),
r AS (SELECT part, p, step, sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails AND failed = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost FROM placed GROUP BY part, p, step)
SELECT part, array_to_string(list_transform(p, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, p[step]) AS BIGINT) AS shapley FROM r"""

SQL = {"op4_warc": _OP4, "op6_sharding": _OP6, "op10_substring_dedup": _OP10, "op12_fill_in_middle": _OP12, "op13_filter_audit": _OP13}

QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_document_fingerprints, op3_license_scans, op4_warc, op5_byte_bpe, op6_sharding, op7_decontamination, op8_quality, op9_simhash, op10_substring_dedup, op11_token_files, op12_fill_in_middle, op13_filter_audit)
}
