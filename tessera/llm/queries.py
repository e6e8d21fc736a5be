"""The registered query of each training-data operator, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, decontaminate, jaccard, linededup, mpegaudio, packing, perspectives, rulequality, sharding, simhash, spelling, suffixdedup, toxicity
from tessera.llm.common import LOWER, UPPER, stored, table

N_SHARDS = 8


def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    return sharding.assign_shards(docs, "doc_id", N_SHARDS, ["text_crc32", "size"])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    media = stored(table(spark, sf_dir, "documents").select("doc_id", n_bytes.alias("n_bytes"), mpegaudio.media_of_text("text").alias("media")), "media")
    return media.select("doc_id", "n_bytes", mpegaudio.media_digest(media["media"]).alias("found")).select("doc_id", "n_bytes", "found.*")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = rulequality.score(docs, rulequality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~toxicity.in_training()).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic")
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", (~toxicity.in_training()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


# CRC-32 by nibbles: fixed values, the remainders of the 16 nibbles.
_CRC_NIBBLES = [
    0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
    0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C,
]

_OP6_SQL = """
WITH p AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> 'system'),
t AS (
  SELECT c.conv_id, p.perspective, c.turn, coalesce(c.text, '') AS text, c.role AS speaker,
         CASE WHEN c.role = 'system' THEN 'system' WHEN c.role = p.perspective THEN 'assistant' ELSE 'user' END AS role
  FROM conversations c JOIN p USING (conv_id)),
r AS (SELECT *, '<|' || role || '|>' || CASE WHEN role = 'user' THEN ' ' || speaker ELSE '' END || chr(10) AS header FROM t),
s AS (
  SELECT *, header || text || '<|end|>' || chr(10) AS rendered,
         CAST(coalesce(sum(length(header || text || '<|end|>' || chr(10))) OVER (PARTITION BY conv_id, perspective ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM r)
SELECT conv_id, perspective, turn, role, rendered, start, start + length(rendered) AS "end",
       CASE WHEN role = 'assistant' THEN start + length(header) END AS mask_start,
       CASE WHEN role = 'assistant' THEN start + length(header) + length(text) + 7 END AS mask_end
FROM s
"""

_OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\\2\\1', 'g'), '') AS nibbles
  FROM documents),
c AS (
  SELECT doc_id, size, xor(CASE WHEN size = 1 THEN 4294967295::BIGINT ELSE list_reduce(nibbles, lambda s, x :
           xor(s >> 4, ({_CRC_NIBBLES}::BIGINT[])[(xor(s, instr('0123456789ABCDEF', x) - 1) & 15) + 1]), 4294967295::BIGINT) END, 4294967295::BIGINT) AS text_crc32
  FROM (SELECT doc_id, size, nibbles FROM d)),
j AS (
  SELECT *, list_reduce(range(9), lambda s, x : CASE WHEN s.j >= 9 THEN s ELSE {{
      'k': (s.k * {sharding.MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT, 'at': s.j, 'before': s.at,
      'j': CAST(floor((s.j + 1) * (2147483648.0::DOUBLE / ((((s.k * {sharding.MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT) >> 33) + 1)::DOUBLE)) AS BIGINT)}} END,
      {{'k': doc_id::HUGEINT, 'at': -1::BIGINT, 'before': -1::BIGINT, 'j': 0::BIGINT}}) AS w
  FROM c)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law,
       CAST(CASE WHEN w.at < 8 THEN w.at ELSE w.before END AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY CASE WHEN w.at < 8 THEN w.at ELSE w.before END ORDER BY doc_id % 1021, doc_id) - 1 AS BIGINT) AS slot,
       CAST(w.at AS INTEGER) AS grown_shard
FROM j
"""

_OP11_SQL = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{6,}}')) AS run FROM documents),
l AS (SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS n FROM r GROUP BY ALL),
c AS (
  SELECT run, n, xor(list_reduce(string_split(regexp_replace(hex(encode(doc_id || ':' || run)), '(.)(.)', '\\2\\1', 'g'), ''), lambda s, x :
           xor(s >> 4, ({_CRC_NIBBLES}::BIGINT[])[(xor(s, instr('0123456789ABCDEF', x) - 1) & 15) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM l),
d AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM c),
w AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
v AS (SELECT word, n, i, length(word) AS size, left(word, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, a.n, b.word AS near, b.n AS m FROM v a JOIN v b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT v.word, v.n, w.word, w.n FROM v JOIN w ON v.rest = w.word
  UNION SELECT w.word, w.n, v.word, v.n FROM v JOIN w ON v.rest = w.word),
b AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM p),
f AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.near END AS form, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n
  FROM w LEFT JOIN (SELECT * FROM b WHERE place = 1) b USING (word)),
t AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.next)
SELECT f.word, f.form, t.at AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word AND t.next IS NULL
"""

_OP8_SQL = f"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (
  SELECT *, CASE WHEN length(key) >= 10 THEN doc_id > min(doc_id) OVER (PARTITION BY key) ELSE false END AS lost FROM k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

_OP4_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]
                                    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gs FROM w),
s AS (SELECT doc_id, unnest(gs) AS g FROM g),
n AS (SELECT doc_id, len(gs) AS n FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL
"""

_QUERIES = {"op1_mpeg_audio": op1_mpeg_audio, "op2_packing": op2_packing, "op3_decontaminate": op3_decontaminate, "op5_quality_rules": op5_quality_rules, "op6_perspectives": op6_perspectives, "op9_suffix_dedup": op9_suffix_dedup, "op10_toxicity": op10_toxicity, "op4_jaccard_join": op4_jaccard_join, "op7_jump_shards": op7_jump_shards, "op8_line_dedup": op8_line_dedup, "op11_spelling_variants": op11_spelling_variants, "op12_simhash_bk_trees": op12_simhash_bk_trees, "op13_token_alignment": op13_token_alignment}
_SQL = {"op6_perspectives": _OP6_SQL, "op4_jaccard_join": _OP4_SQL, "op7_jump_shards": _OP7_SQL, "op8_line_dedup": _OP8_SQL, "op11_spelling_variants": _OP11_SQL}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)
