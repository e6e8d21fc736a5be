"""Every query of the retrieval engine with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import changes, cochange, evaluation, filters, fusion, graph, pack, resolve, retrieval, state, vector_index
from tessera.plans import tables as t
from tessera.plans.tables import table
from tessera.schema import MAX_COMMIT_FILES

_QUERIES: dict = {}
_SQL: dict = {}

TERMS = ["thing", "with", "retion"]
SEED = 1
SEEDS = (1, 2, 3, 5, 8)
_TERM_LIST = ", ".join(f"'{x}'" for x in TERMS)


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


_TOKEN = r"[\p{L}\p{M}\p{N}_]+"


def _bm25_sql(idf: bool, terms: str = _TERM_LIST) -> str:
    weight = "ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * " if idf else ""
    return f"""
d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_TOKEN}') AS toks FROM documents),
s AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM d),
p AS (SELECT doc_id, len(toks) AS dl, tok FROM (SELECT doc_id, toks, unnest(toks) AS tok FROM d)),
tf AS (SELECT doc_id, dl, tok, count(*) AS tf FROM p WHERE tok IN ({terms}) GROUP BY ALL),
f AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
bm AS (SELECT tf.doc_id, round(sum({weight}tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.dl / s.avg_len))), 6) AS score FROM tf JOIN f USING (tok), s GROUP BY tf.doc_id)"""


_KNN_SQL = """
q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0),
nn AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS score FROM embeddings, q)"""


def _bm25(spark: SparkSession, sf_dir: str, idf: bool = True, terms: list[str] = TERMS) -> DataFrame:
    return retrieval.bm25_postings(*t.document_postings(spark, sf_dir, terms), terms, "doc_id", idf)


def _knn(points: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.knn(points, table(spark, sf_dir, "embeddings").filter("vec_id = 0"), "vec_id", "embedding")


# ---- search


@query(f"""
WITH {_bm25_sql(True)}, {_KNN_SQL},
l AS (
  SELECT doc_id AS id, 1 AS list_no, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 30
  UNION ALL SELECT vec_id, 0, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM nn QUALIFY rank <= 30)
SELECT id AS chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM l GROUP BY id
ORDER BY score DESC, min(list_no * 1000 + rank), id LIMIT 10
""")
def q01_hybrid_rrf(spark, sf_dir):
    dense = _knn(table(spark, sf_dir, "embeddings"), spark, sf_dir).withColumnRenamed("vec_id", "chunk_id")
    return retrieval.hybrid(_bm25(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id"), dense, "chunk_id", 10).select("chunk_id", "score")


@query(f"WITH {_bm25_sql(True)} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 20")
def q02_bm25_topk(spark, sf_dir):
    return retrieval.top(_bm25(spark, sf_dir), "doc_id", 20)


@query(f"WITH {_bm25_sql(False)} SELECT doc_id, score FROM bm")
def q03_bm25_literal_no_idf(spark, sf_dir):
    return _bm25(spark, sf_dir, idf=False)


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS toks FROM documents),
s AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM d),
q AS (SELECT item_id AS query, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'))) AS tok FROM benchmark WHERE item_id % 20 = 0),
tf AS (SELECT doc_id, dl, tok, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS tok FROM d) WHERE tok IN (SELECT tok FROM q) GROUP BY ALL),
f AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
b AS (SELECT query, doc_id, round(sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.dl / s.avg_len))), 6) AS score FROM tf JOIN f USING (tok) JOIN q USING (tok), s GROUP BY ALL)
SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INTEGER AS rank FROM b QUALIFY rank <= 10""")
def q02b_bm25_many(spark, sf_dir):
    """A batch of queries in one job: the benchmark items whose id 20 divides."""
    asked = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query"), "text")
    return retrieval.bm25_many(*t.document_postings(spark, sf_dir), asked, "doc_id", 10)


_PHRASE = "Über-straße, Être; l'été niño São mức"


@query(f"WITH {_bm25_sql(True, chr(39) + (chr(39) + ', ' + chr(39)).join(['über', 'straße', 'être', 'l', 'été', 'niño', 'são', 'mức']) + chr(39))} SELECT doc_id, score FROM bm")
def q03b_bm25_any_script(spark, sf_dir):
    """A query as a user types it, cut by the rule that cut the texts: hyphens, apostrophes, capitals and letters beyond ASCII."""
    return _bm25(spark, sf_dir, terms=tx.query_terms(spark, _PHRASE))


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS term FROM documents)
SELECT term, count(*)::BIGINT AS total, count(DISTINCT doc_id)::BIGINT AS df FROM t WHERE term <> regexp_replace(term, '[^a-z0-9_]', '', 'g') GROUP BY term""")
def q03c_postings_beyond_ascii(spark, sf_dir):
    """What the postings hold of terms with letters beyond ASCII."""
    rows, _ = t.document_postings(spark, sf_dir)
    return rows.filter(~F.col("term").rlike("^[a-z0-9_]*$")).groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))


@query(f"WITH {_KNN_SQL} SELECT vec_id, score FROM nn ORDER BY score DESC, vec_id LIMIT 20")
def q04_knn_topk(spark, sf_dir):
    return retrieval.top(_knn(table(spark, sf_dir, "embeddings"), spark, sf_dir), "vec_id", 20)


@query(f"WITH {_KNN_SQL} SELECT vec_id, score FROM nn ORDER BY score DESC, vec_id LIMIT 20")
def q04b_knn_index_all_lists(spark, sf_dir):
    """The same from the inverted file, in its exact setting."""
    asked = table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()
    return vector_index.nearest_to(spark, t.vector_index_path(spark, sf_dir), asked["embedding"] if asked else [], 20, probes=None)


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@query()
def q04c_knn_index(spark, sf_dir):
    """The 20 nearest to every vector whose id 20 divides, from as many lists as the index has measured; recall is held against q04d in tests/test_vector_index.py."""
    return vector_index.nearest(spark, t.vector_index_path(spark, sf_dir), _vector_queries(spark, sf_dir), 20)


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e q, e WHERE q.vec_id % 20 = 0)
SELECT query, vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 20""")
def q04d_knn_index_exact_batch(spark, sf_dir):
    return vector_index.nearest(spark, t.vector_index_path(spark, sf_dir), _vector_queries(spark, sf_dir), 20, probes=None)


@query(f"WITH {_KNN_SQL} SELECT vec_id, score FROM nn WHERE label IN (1, 3, 5) ORDER BY score DESC, vec_id LIMIT 20")
def q05_knn_filtered(spark, sf_dir):
    kept = filters.matching(table(spark, sf_dir, "embeddings"), {"label": [1, 3, 5], "vec_id": None})
    return retrieval.top(_knn(kept, spark, sf_dir), "vec_id", 20)


def _collection_hits(spark: SparkSession, sf_dir: str, lose_links: bool) -> DataFrame:
    """Documents as code, conversations as their descriptions: a first turn describes the document of the conversation's number."""
    code = _bm25(spark, sf_dir).select(F.lit("code_ts").alias("collection"), F.col("doc_id").alias("chunk_id"), F.lit(None).cast("long").alias("linked_chunk_id"), "score")
    described = retrieval.bm25_postings(*t.turn_postings(spark, sf_dir, TERMS), TERMS, "turn_id")
    link = F.floor(F.col("turn_id") / 1000)
    link = F.when(F.col("turn_id") % 2 == 1, None).otherwise(link) if lose_links else link
    return code.unionByName(described.select(F.lit("code_ts_desc").alias("collection"), F.col("turn_id").alias("chunk_id"), link.alias("linked_chunk_id"), "score"))


def _merge_sql(link: str) -> str:
    turns = _bm25_sql(True).replace("SELECT doc_id, regexp", "SELECT conv_id * 1000 + turn AS doc_id, regexp").replace("FROM documents", "FROM conversations")
    for name in ("d", "s", "p", "tf", "f", "bm"):
        turns = turns.replace(f"\n{name} AS (", f"\n{name}2 AS (")
    turns = turns.replace("FROM d)", "FROM d2)").replace("FROM d GROUP", "FROM d2 GROUP").replace("avg_len FROM d2)", "avg_len FROM d2)").replace("FROM p ", "FROM p2 ").replace("FROM tf GROUP", "FROM tf2 GROUP").replace("FROM tf JOIN f USING (tok), s", "FROM tf2 tf JOIN f2 f USING (tok), s2 s")
    return f"""
WITH {_bm25_sql(True)}, {turns},
h AS (
  SELECT 'code_ts' AS collection, doc_id AS own, doc_id AS chunk_id, score FROM bm
  UNION ALL SELECT 'code_ts_desc', doc_id, {link}, score FROM bm2),
r AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, own) AS rank FROM h WHERE chunk_id IS NOT NULL QUALIFY rank <= 30),
m AS (SELECT chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, arg_min(collection, (CASE WHEN collection = 'code_ts' THEN 0 ELSE 100000000 END) + rank) AS matched_collection FROM r GROUP BY chunk_id)
SELECT *, CASE matched_collection WHEN 'code_ts' THEN 'code' ELSE 'description' END AS matched_via FROM m"""


@query(_merge_sql("CAST(floor(doc_id / 1000) AS BIGINT)"))
def q06_cross_collection_merge(spark, sf_dir):
    merged = fusion.merge_collections(_collection_hits(spark, sf_dir, False), ["code_ts", "code_ts_desc"], depth=retrieval.over_fetch(10))
    return merged.select("chunk_id", "score", "matched_collection", "matched_via")


@query(_merge_sql("CASE WHEN doc_id % 2 = 1 THEN NULL ELSE CAST(floor(doc_id / 1000) AS BIGINT) END"))
def q07_rrf_missing_link(spark, sf_dir):
    merged = fusion.merge_collections(_collection_hits(spark, sf_dir, True), ["code_ts", "code_ts_desc"], depth=retrieval.over_fetch(10))
    return merged.select("chunk_id", "score", "matched_collection", "matched_via")


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'fr'")
def q08_filter_scalar(spark, sf_dir):
    return filters.matching(table(spark, sf_dir, "documents"), {"lang": "fr"}).select("doc_id", "n_chars")


@query("SELECT doc_id, n_chars FROM documents WHERE lang IN ('de', 'es') AND source = 'src3'")
def q09_filter_list(spark, sf_dir):
    return filters.matching(table(spark, sf_dir, "documents"), {"lang": ["de", "es"], "source": "src3"}).select("doc_id", "n_chars")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def q10_filter_none(spark, sf_dir):
    return filters.matching(table(spark, sf_dir, "documents"), {"source": None}).groupBy("lang").agg(F.count("*").alias("n"))


# ---- documents

_SPACES = " || ".join(f"chr({ord(c)})" for c in tx.SPACE)
_STRIP = f"trim(text, {_SPACES})"
_WINDOWS_SQL = f"""
b AS (SELECT doc_id, {_STRIP} AS body FROM documents WHERE length({_STRIP}) > 0),
w AS (SELECT doc_id, body, unnest(range(0, greatest(length(body) - 1200 + 1049, 0) // 1050 * 1050 + 1, 1050)) AS char_start FROM b)"""


@query(f"WITH {_WINDOWS_SQL} SELECT doc_id, (char_start // 1050)::BIGINT AS chunk_index, char_start::BIGINT AS char_start, md5(substring(body, char_start + 1, 1200)) AS content_md5 FROM w")
def q11_chunk_windows(spark, sf_dir):
    w = t.doc_windows(spark, sf_dir)
    return w.select("doc_id", F.col("window").cast("long").alias("chunk_index"), F.col("char_start").cast("long").alias("char_start"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"""WITH {_WINDOWS_SQL},
c AS (SELECT *, substring(body, char_start + 1, 1200) AS content, substring(body, 1, char_start) AS ahead FROM w)
SELECT doc_id, (char_start // 1050)::BIGINT AS chunk_index, (1 + length(ahead) - length(replace(ahead, chr(10), '')))::BIGINT AS line_start,
       (1 + length(ahead) - length(replace(ahead, chr(10), '')) + length(content) - length(replace(content, chr(10), '')))::BIGINT AS line_end FROM c""")
def q12_chunk_line_numbers(spark, sf_dir):
    start = F.col("lines_before") + 1
    return t.doc_windows(spark, sf_dir).select(
        "doc_id", F.col("window").cast("long").alias("chunk_index"), start.cast("long").alias("line_start"), (start + tx.count_of(F.col("content"), "\n")).cast("long").alias("line_end"))


@query("""
WITH m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations)
SELECT conv_id, section::BIGINT AS section, count(*)::BIGINT AS turns, sum(length(text))::BIGINT AS chars, string_agg(role, ',' ORDER BY turn) AS roles FROM m GROUP BY conv_id, section""")
def q13_section_split(spark, sf_dir):
    opened = Window.partitionBy("conv_id").orderBy("turn")
    m = table(spark, sf_dir, "conversations").withColumn("section", F.sum((F.col("role") == "user").cast("long")).over(opened))
    roles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",")
    return m.groupBy("conv_id", "section").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), roles.alias("roles"))


_HEADING_SQL = r"^(#{1,6})\s+(.+?)\s*$"


@query(f"""
WITH d AS (SELECT conv_id, string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn) AS md FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM (SELECT conv_id, string_split(md, chr(10)) AS ls FROM d)),
m AS (SELECT *, regexp_matches(line, '{_HEADING_SQL}') AS head FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY conv_id ORDER BY line_no) AS section FROM m),
g AS (SELECT conv_id, section, max(CASE WHEN head THEN trim(regexp_extract(line, '{_HEADING_SQL}', 2)) END) AS title, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT head), '') AS body,
             coalesce(min(line_no) FILTER (NOT head), 0) + 1 AS first_line FROM s GROUP BY conv_id, section),
b AS (SELECT *, trim(body, {_SPACES}) AS inner_, length(body) - length(ltrim(body, {_SPACES})) AS skipped FROM g),
w AS (SELECT *, unnest(range(0, greatest(length(inner_) - 1200 + 1049, 0) // 1050 * 1050 + 1, 1050)) AS char_start FROM b WHERE length(inner_) > 0),
c AS (SELECT *, substring(inner_, char_start + 1, 1200) AS content, substring(body, 1, skipped) || substring(inner_, 1, char_start) AS ahead FROM w)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY section, char_start) - 1)::BIGINT AS chunk_index, title, md5(content) AS content_md5,
       (first_line + length(ahead) - length(replace(ahead, chr(10), '')))::BIGINT AS line_start,
       (first_line + length(ahead) - length(replace(ahead, chr(10), '')) + length(content) - length(replace(content, chr(10), '')))::BIGINT AS line_end FROM c""")
def q13b_markdown_chunks(spark, sf_dir):
    """Conversations as Markdown with a heading for each turn, through the chunker."""
    turns = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n"), x["text"])), "\n")
    made = table(spark, sf_dir, "conversations").filter("text is not null").groupBy("conv_id").agg(turns.alias("md"))
    cut = tx.chunks(made, ["conv_id"], "md")
    return cut.select("conv_id", F.col("chunk_index").cast("long").alias("chunk_index"), "title", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


@query(r"""
WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS body FROM pages),
w AS (SELECT page_id, body, unnest(range(0, greatest(length(body) - 1200 + 1049, 0) // 1050 * 1050 + 1, 1050)) AS s FROM p WHERE length(body) > 0)
SELECT page_id, (s // 1050)::BIGINT AS chunk_index, md5(substring(body, s + 1, 1200)) AS content_md5 FROM w""")
def q14_html_chunks(spark, sf_dir):
    return t.page_windows(spark, sf_dir).select("page_id", F.col("window").cast("long").alias("chunk_index"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("SELECT sha256(text) AS content_hash, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def q15_content_hash_dups(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


# ---- history

_FILES_SQL = """
cf AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS f FROM lineitem),
sized AS (SELECT c, f, count(*) OVER (PARTITION BY c) AS n FROM cf)"""


def _pairs_sql(most: int | None, least: int, extra: str = "") -> str:
    where = f"AND a.n <= {most}" if most else ""
    return f"""{_FILES_SQL},
pairs AS (SELECT a.f AS file_a, b.f AS file_b, count(*)::BIGINT AS count{extra} FROM sized a JOIN sized b ON a.c = b.c AND a.f < b.f {where}
          {"JOIN orders o ON o.o_orderkey = a.c" if extra else ""} GROUP BY a.f, b.f HAVING count(*) >= {least})"""


def _pairs(spark: SparkSession, sf_dir: str, least: int, most: int = MAX_COMMIT_FILES) -> DataFrame:
    return cochange.co_change_pairs(t.commit_files(spark, sf_dir), least, most, t.history_parts(spark, sf_dir))


@query(f"WITH {_pairs_sql(30, 3)} SELECT * FROM pairs")
def q16_co_change_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, 3).select("file_a", "file_b", "count")


@query(f"WITH {_pairs_sql(4, 3)} SELECT * FROM pairs")
def q17_co_change_capped(spark, sf_dir):
    return _pairs(spark, sf_dir, 3, 4).select("file_a", "file_b", "count")


@query(f"WITH {_pairs_sql(8, 3, ', max(o.o_orderdate) AS last_seen')} SELECT * FROM pairs")
def q18_co_change_last_seen(spark, sf_dir):
    return _pairs(spark, sf_dir, 3, 8)


def _seeds(spark: SparkSession, values=SEEDS) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "seed long")


_SEED_LIST = ", ".join(map(str, SEEDS))


@query(f"""WITH {_pairs_sql(30, 1)},
u AS (SELECT file_a AS seed, file_b AS other, count FROM pairs UNION ALL SELECT file_b, file_a, count FROM pairs)
SELECT seed, other, count FROM u WHERE seed IN ({_SEED_LIST}) AND count >= 3 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY count DESC, other) <= 8""")
def q19_co_changed_for(spark, sf_dir):
    return graph.co_changed(_pairs(spark, sf_dir, 1), _seeds(spark))


@query("SELECT s_suppkey AS file, count(DISTINCT l_orderkey)::BIGINT AS commits, max(o_orderdate) AS latest FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def q20_commits_touch(spark, sf_dir):
    touched = t.commit_files(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file")), "file", "left_semi")
    return touched.groupBy("file").agg(F.count("*").alias("commits"), F.max("date").alias("latest"))


@query("""
WITH d AS (SELECT DISTINCT l_suppkey AS seed, l_orderkey AS hash FROM lineitem)
SELECT seed, hash, o_orderdate AS date FROM d JOIN orders ON o_orderkey = hash QUALIFY row_number() OVER (PARTITION BY seed ORDER BY o_orderdate DESC, hash) <= 5""")
def q21_recent_commits_per_file(spark, sf_dir):
    return graph.recent_commits(t.commit_files(spark, sf_dir).select(F.col("file").alias("seed"), F.col("commit").alias("hash"), "date"))


# ---- graph

_EDGES_SQL = """
e AS (
  SELECT l_suppkey AS src, l_partkey % 997 AS dst,
         round(arg_max(round(1 - l_discount, 2), {'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice, 'd': round(1 - l_discount, 2)}), 2) AS c
  FROM lineitem GROUP BY 1, 2)"""


def _hops_sql(towards: bool, hops: int, seeds: str, limit: int | None = 25) -> str:
    at, to = ("dst", "src") if towards else ("src", "dst")
    two = f" UNION ALL SELECT a.{at}, b.{to}, 2, round(a.c * b.c, 6) FROM e a JOIN e b ON b.{at} = a.{to} WHERE a.{at} IN ({seeds}) AND NOT (a.src = b.src AND a.dst = b.dst)" if hops > 1 else ""
    if hops > 2:
        other = lambda x, y: f"NOT ({x}.src = {y}.src AND {x}.dst = {y}.dst)"
        two += f" UNION ALL SELECT a.{at}, d.{to}, 3, round(a.c * b.c * d.c, 6) FROM e a JOIN e b ON b.{at} = a.{to} JOIN e d ON d.{at} = b.{to} WHERE a.{at} IN ({seeds}) AND {other('a', 'b')} AND {other('a', 'd')} AND {other('b', 'd')}"
    paths = f"p AS (SELECT {at} AS seed, {to} AS node, 1 AS hops, round(c, 6) AS confidence FROM e WHERE {at} IN ({seeds}){two})"
    if limit is None:
        return f"WITH {_EDGES_SQL}, {paths} SELECT seed, node, hops, confidence FROM p"
    return f"""WITH {_EDGES_SQL}, {paths}, u AS (SELECT DISTINCT * FROM p WHERE node <> seed)
SELECT seed, node, hops, confidence FROM u QUALIFY row_number() OVER (PARTITION BY seed ORDER BY hops, confidence DESC, node) <= {limit}"""


@query(_hops_sql(True, 1, _SEED_LIST))
def q22_callers_1hop(spark, sf_dir):
    return graph.neighbours(_seeds(spark), t.edges(spark, sf_dir), 1)


@query(_hops_sql(True, 2, _SEED_LIST, 100000))
def q23_callers_2hop(spark, sf_dir):
    return graph.neighbours(_seeds(spark), t.edges(spark, sf_dir), 2, limit=100000)


@query(_hops_sql(False, 2, _SEED_LIST))
def q24_callees_2hop(spark, sf_dir):
    return graph.neighbours(_seeds(spark), t.edges(spark, sf_dir), 2, towards=False)


@query(_hops_sql(True, 2, str(SEED), None))
def q25_callers_simple_paths(spark, sf_dir):
    return graph.paths(_seeds(spark, [SEED]), t.edges(spark, sf_dir), 2)


@query(f"""WITH {_hops_sql(True, 3, str(SEED), None).removeprefix("WITH ").replace("SELECT seed, node, hops, confidence FROM p", ", u AS (SELECT node, hops, confidence FROM p)")}
SELECT hops, count(*)::BIGINT AS paths, count(DISTINCT node)::BIGINT AS nodes, round(max(confidence), 6) AS best FROM u GROUP BY hops""")
def q25b_callers_3hop_paths(spark, sf_dir):
    found = graph.path_counts(_seeds(spark, [SEED]), t.edges(spark, sf_dir), 3)
    return found.groupBy("hops").agg(F.sum("paths").alias("paths"), F.countDistinct("node").alias("nodes"), F.max("best").alias("best"))


@query(f"WITH {_EDGES_SQL} SELECT src, dst, c AS confidence FROM e WHERE src IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def q26b_edges_of_real_sources(spark, sf_dir):
    """A relation is written only where its source exists: here suppliers in credit."""
    there = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("node"))
    return graph.real_edges(t.edges(spark, sf_dir), there, "node").select("src", "dst", "confidence")


@query(f"WITH {_EDGES_SQL} SELECT src, dst, 'CALLS' AS rel_type, c AS confidence FROM e")
def q26_edge_merge_last_write(spark, sf_dir):
    return graph.merge_edges(t.edge_writes(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_extendedprice"])


@query("""
WITH f AS (SELECT p_brand AS file_path, p_name AS name, min(p_partkey) AS qn FROM part GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, p_brand AS file_path, p_name AS to_name, 'part-' || f.qn AS to_qn, greatest(round(1 - l_discount, 2), 0.9) AS confidence
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN f ON f.file_path = p_brand AND f.name = p_name""")
def q27_same_file_resolve(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    entities = part.select(F.col("p_brand").alias("file_path"), F.col("p_name").alias("name"), F.concat(F.lit("part-"), F.col("p_partkey")).alias("qualified_name"), F.col("p_partkey").alias("ordinal"))
    calls = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.round(1 - F.col("l_discount"), 2).alias("confidence"))
    relations = calls.join(part, "p_partkey").select(
        "l_orderkey", "l_linenumber", F.col("p_brand").alias("file_path"), F.col("p_name").alias("to_name"), "confidence", F.lit("heuristic").alias("resolution_type"), F.lit(None).cast("string").alias("to_qn"))
    return resolve.same_file(relations, entities).select("l_orderkey", "l_linenumber", "file_path", "to_name", "to_qn", "confidence")


@query("""SELECT p_brand AS src, 'part-' || p_partkey AS dst, 'DEFINES' AS rel_type FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_size % 2 = 0)""")
def q27b_defines_edges(spark, sf_dir):
    """Edges from a module to what its file defines: brands are files, and have a module if one of their parts has an even size."""
    part = table(spark, sf_dir, "part")
    symbols = part.select(F.col("p_brand").alias("file_path"), F.concat(F.lit("part-"), F.col("p_partkey")).alias("qualified_name"), F.lit("class").alias("symbol_type"))
    modules = part.filter("p_size % 2 = 0").select(F.col("p_brand").alias("file_path"), F.col("p_brand").alias("qualified_name"), F.lit("module").alias("symbol_type")).distinct()
    return resolve.defines(symbols.unionByName(modules)).select("src", "dst", "rel_type")


@query("SELECT DISTINCT l_partkey % 997 AS node FROM lineitem WHERE l_partkey % 997 NOT IN (SELECT s_suppkey FROM supplier)")
def q28_placeholders(spark, sf_dir):
    return graph.placeholders(t.edges(spark, sf_dir), t.nodes(spark, sf_dir), "node")


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages),
o AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM p WHERE page_id % 3 = 0 UNION SELECT DISTINCT regexp_extract(path, '^(.*?//[^/]+)', 1) FROM p)
SELECT page_id, path, folder AS owner FROM p LEFT JOIN o ON starts_with(path, folder || '/') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(folder) DESC, folder DESC) = 1""")
def q29_deepest_owner(spark, sf_dir):
    """Pages' owners among two kinds of folders: the site, and the folder of every page whose number 3 divides."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    folders = pages.filter("page_id % 3 = 0").select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder"))
    sites = pages.select(F.regexp_extract("path", r"^(.*?//[^/]+)", 1).alias("folder"))
    return pack.deepest_owner(pages, folders.unionByName(sites).distinct(), "path", "folder").select("page_id", "path", "owner")


@query("""
WITH r AS (SELECT doc_id AS seed, item_id AS issue_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))
SELECT seed, issue_id FROM r QUALIFY row_number() OVER (PARTITION BY seed ORDER BY issue_id) <= 20""")
def q30_related_issues(spark, sf_dir):
    issues = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("issue_id"), F.col("text").alias("passage"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seed"), "text")
    return graph.related_issues(graph.containing(docs, issues))


def _related_sql(key: str) -> str:
    return f"""
WITH i AS (
  SELECT item_id AS issue_id, text AS passage FROM benchmark UNION ALL SELECT item_id + 1000, split_part(text, ' ', 2) FROM benchmark UNION ALL SELECT item_id + 2000, split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) FROM benchmark),
r AS (SELECT DISTINCT doc_id AS seed, issue_id FROM documents d JOIN i ON contains(d.text, i.passage))
SELECT seed, {key} FROM r QUALIFY row_number() OVER (PARTITION BY seed ORDER BY issue_id) <= 20"""


@query(_related_sql("issue_id"))
def q30b_related_issues_short(spark, sf_dir):
    """Passages of one and of two words among them, which may begin and end inside words."""
    items = table(spark, sf_dir, "benchmark")
    word = lambda n: F.split_part("text", F.lit(" "), F.lit(n))
    issues = items.select(F.col("item_id").alias("issue_id"), F.col("text").alias("passage")).unionByName(items.select((F.col("item_id") + 1000).alias("issue_id"), word(2).alias("passage"))).unionByName(
        items.select((F.col("item_id") + 2000).alias("issue_id"), F.concat_ws(" ", word(2), word(3)).alias("passage")))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seed"), "text")
    return graph.related_issues(graph.containing(docs, issues))


@query(f"""
WITH {_EDGES_SQL},
{_pairs_sql(8, 1).strip()},
ends AS (SELECT file_a AS chunk_id FROM pairs UNION ALL SELECT file_b FROM pairs),
co AS (SELECT chunk_id, least(count(*), 8) AS n FROM ends GROUP BY 1),
issues AS (SELECT d.doc_id AS chunk_id, least(count(DISTINCT b.item_id), 20) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1),
h AS (SELECT s_suppkey AS chunk_id FROM supplier),
callers AS (SELECT dst AS chunk_id, least(count(*), 25) AS n FROM e WHERE src <> dst GROUP BY 1),
callees AS (SELECT src AS chunk_id, least(count(*), 25) AS n FROM e WHERE src <> dst GROUP BY 1),
commits AS (SELECT l_suppkey AS chunk_id, least(count(DISTINCT l_orderkey), 5) AS n FROM lineitem GROUP BY 1)
SELECT chunk_id, coalesce(a.n, 0)::BIGINT AS n_callers, coalesce(b.n, 0)::BIGINT AS n_callees, coalesce(c.n, 0)::BIGINT AS n_commits, coalesce(co.n, 0)::BIGINT AS n_co_changed, coalesce(i.n, 0)::BIGINT AS n_issues
FROM h LEFT JOIN callers a USING (chunk_id) LEFT JOIN callees b USING (chunk_id) LEFT JOIN commits c USING (chunk_id) LEFT JOIN co USING (chunk_id) LEFT JOIN issues i USING (chunk_id)""")
def q31_graph_context_pack(spark, sf_dir):
    return _context(spark, sf_dir).select("chunk_id", *(F.size(f"graph_context.{c}").cast("long").alias(n) for c, n in (("callers", "n_callers"), ("callees", "n_callees"), ("recent_commits", "n_commits"), ("co_changed", "n_co_changed"), ("related_issues", "n_issues"))))


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = t.nodes(spark, sf_dir).select(F.col("node").alias("chunk_id"), F.col("name").alias("qualified_name"))
    seeds, edges, files = hits.select(F.col("chunk_id").alias("seed")), t.edges(spark, sf_dir), t.commit_files(spark, sf_dir)
    commits = graph.recent_commits(files.select(F.col("file").alias("seed"), F.col("commit").alias("hash"), F.date_format("date", "yyyy-MM-dd").alias("date")))
    co = graph.co_changed(_pairs(spark, sf_dir, 1, 8), seeds, None)
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("issue_id"), F.col("text").alias("passage"))
    issues = graph.related_issues(graph.containing(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seed"), "text"), passages))
    return graph.graph_context(hits, graph.neighbours(seeds, edges, 1), graph.neighbours(seeds, edges, 1, False), co, commits, issues)


def _list_sql(rows: str, key: str, order: str, limit: int, fields: str) -> str:
    """A hit's list as JSON: the first rows of each seed, in the order of their fields."""
    return f"SELECT seed, to_json(list({{{fields}}} ORDER BY {', '.join(x.split(':')[1].strip() for x in fields.split(','))})) AS j FROM (SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY {order}) <= {limit}) GROUP BY seed"


@query(f"""
WITH {_EDGES_SQL},
{_pairs_sql(8, 1).strip()},
er AS (SELECT src, dst, round(c, 6) AS c FROM e),
l1 AS ({_list_sql("SELECT dst AS seed, src AS node, 1 AS hops, c AS confidence FROM er WHERE src <> dst", "seed", "hops, confidence DESC, node", 25, "node: node, hops: hops, confidence: confidence")}),
l2 AS ({_list_sql("SELECT src AS seed, dst AS node, 1 AS hops, c AS confidence FROM er WHERE src <> dst", "seed", "hops, confidence DESC, node", 25, "node: node, hops: hops, confidence: confidence")}),
l3 AS ({_list_sql("SELECT file_a AS seed, file_b AS other, count FROM pairs UNION ALL SELECT file_b, file_a, count FROM pairs", "seed", "count DESC, other", 8, "other: other, count: count")}),
l4 AS ({_list_sql("SELECT DISTINCT l_suppkey AS seed, l_orderkey AS hash, strftime(o_orderdate, '%Y-%m-%d') AS date FROM lineitem JOIN orders ON o_orderkey = l_orderkey", "seed", "date DESC, hash", 5, "hash: hash, date: date")}),
l5 AS ({_list_sql("SELECT DISTINCT d.doc_id AS seed, b.item_id AS issue_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)", "seed", "issue_id", 20, "issue_id: issue_id")})
SELECT s_suppkey AS chunk_id, '{{"chunk_id":' || s_suppkey || ',"qualified_name":' || to_json(s_name) || ',"graph_context":{{"callers":' || coalesce(l1.j::VARCHAR, '[]') || ',"callees":' || coalesce(l2.j::VARCHAR, '[]')
       || ',"co_changed":' || coalesce(l3.j::VARCHAR, '[]') || ',"recent_commits":' || coalesce(l4.j::VARCHAR, '[]') || ',"related_issues":' || coalesce(l5.j::VARCHAR, '[]') || '}}}}' AS json
FROM supplier LEFT JOIN l1 ON l1.seed = s_suppkey LEFT JOIN l2 ON l2.seed = s_suppkey LEFT JOIN l3 ON l3.seed = s_suppkey LEFT JOIN l4 ON l4.seed = s_suppkey LEFT JOIN l5 ON l5.seed = s_suppkey""")
def q31b_graph_context_json(spark, sf_dir):
    return pack.packed(_context(spark, sf_dir)).select("chunk_id", "json")


@query("""SELECT qualified_name, name, chunk_id FROM (SELECT 'src/c' || c_nationkey || '.ts::' || c_name AS qualified_name, c_name AS name, c_custkey AS chunk_id FROM customer
UNION ALL SELECT 'Customer#000000042', 'other', 0) WHERE qualified_name = 'Customer#000000042' OR name = 'Customer#000000042' ORDER BY (qualified_name = 'Customer#000000042') DESC, qualified_name LIMIT 5""")
def q32_symbol_lookup(spark, sf_dir):
    """An exact qualified name before short names."""
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("src/c"), F.col("c_nationkey"), F.lit(".ts::"), F.col("c_name")).alias("qualified_name"), F.col("c_name").alias("name"), F.col("c_custkey").alias("chunk_id"))
    whole = spark.createDataFrame([("Customer#000000042", "other", 0)], "qualified_name string, name string, chunk_id long")
    return retrieval.lookup_symbol(customers.unionByName(whole), "Customer#000000042", 5)


# ---- changes and state


@query(r"""
WITH k AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'))) AS name FROM documents),
a AS (SELECT DISTINCT name FROM k WHERE source = 'src1'), b AS (SELECT DISTINCT name FROM k WHERE source = 'src2')
(SELECT name FROM a EXCEPT SELECT name FROM b) UNION ALL (SELECT name FROM b EXCEPT SELECT name FROM a)""")
def q33_name_symmetric_diff(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select("source", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("name"))
    side = lambda s: names.filter(F.col("source") == s).select("name").distinct()
    return changes.symmetric_difference(side("src1"), side("src2"))


@query(r"""
WITH k AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'))) AS token FROM documents),
n AS (SELECT DISTINCT unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'))) AS token FROM benchmark),
p AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT DISTINCT doc_id FROM k WHERE token IN (SELECT token FROM n WHERE length(token) >= 12) AND doc_id NOT IN (SELECT doc_id FROM p)""")
def q34_referencers_token_join(spark, sf_dir):
    mentions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_path"), F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token"))
    names = table(spark, sf_dir, "benchmark").select(F.explode(tx.tokens(F.col("text"))).alias("name")).distinct().filter(F.length("name") >= 12)
    processed = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("file_path"))
    return changes.referencers(mentions, names, processed).select(F.col("file_path").alias("doc_id"))


@query("""
WITH e AS (SELECT p_partkey AS ordinal, p_brand AS file_path, p_name AS name, 'q' || p_partkey AS qn FROM part),
gone AS (SELECT DISTINCT name FROM e WHERE file_path = 'Brand#11'), left_ AS (SELECT * FROM e WHERE file_path <> 'Brand#11'),
r AS (SELECT l_orderkey, l_linenumber, 'src/u' || l_suppkey || '.ts' AS file_path, p_name AS to_name FROM lineitem JOIN part ON p_partkey = l_partkey),
hit AS (SELECT DISTINCT file_path FROM r WHERE to_name IN (SELECT name FROM gone)),
once AS (SELECT name, min(qn) AS qn FROM left_ GROUP BY name HAVING count(*) = 1)
SELECT r.file_path, r.to_name, once.qn AS to_qn, CASE WHEN once.qn IS NULL THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, count(*)::BIGINT AS n
FROM r JOIN hit USING (file_path) LEFT JOIN once ON once.name = r.to_name GROUP BY ALL""")
def q34b_relinked_relations(spark, sf_dir):
    """After a file (a brand) is deleted: the files that call a name of it have all their calls resolved again, to the one symbol of that name that is left, or to none."""
    part = table(spark, sf_dir, "part")
    entities = part.select(F.col("p_brand").alias("file_path"), F.col("p_name").alias("name"), F.concat(F.lit("q"), F.col("p_partkey")).alias("qualified_name"), F.lit("class").alias("symbol_type"), F.col("p_partkey").alias("ordinal"))
    calls = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("src/u"), F.col("l_suppkey"), F.lit(".ts")).alias("file_path"), F.col("p_name").alias("to_name"), F.lit("CALLS").alias("rel_type"), F.lit(0.9).alias("confidence"), F.lit("heuristic").alias("resolution_type"), F.lit(None).cast("string").alias("to_qn"))
    change = spark.createDataFrame([("deleted", "Brand#11", None)], "status string, path string, old_path string")
    after = entities.filter("file_path <> 'Brand#11'")
    names = changes.affected_names(change, entities.select("file_path", "name"), after.select("file_path", "name"))
    hit = changes.referencers(calls.select("file_path", F.col("to_name").alias("token")), names, changes.changed_paths(change).withColumnRenamed("path", "file_path"))
    linked = resolve.cross_file(resolve.same_file(calls.join(hit, "file_path", "left_semi"), after), after)
    return linked.groupBy("file_path", "to_name", "to_qn", "confidence").agg(F.count("*").alias("n"))


_CHANGES_SQL = """
ch AS (
  SELECT CASE event_type WHEN 'click' THEN 'modified' WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE CASE WHEN value < 50 THEN 'renamed' ELSE 'deleted' END END AS status,
         CASE WHEN event_type = 'purchase' AND value < 50 THEN 'src/e' || event_id || '.ts' ELSE 'src/u' || user_id || '.ts' END AS path,
         CASE WHEN event_type = 'purchase' AND value < 50 THEN 'src/u' || user_id || '.ts' END AS old_path
  FROM events WHERE event_type <> 'view')"""


@query(f"WITH {_CHANGES_SQL} SELECT status, path, old_path, count(*)::BIGINT AS n FROM ch GROUP BY ALL")
def q35_change_decode(spark, sf_dir):
    return _changes(spark, sf_dir).groupBy("status", "path", "old_path").agg(F.count("*").alias("n"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.gitlog import decode_changes

    return decode_changes(t.change_lines(spark, sf_dir))


@query(f"WITH {_CHANGES_SQL} SELECT path FROM ch UNION SELECT old_path FROM ch WHERE old_path IS NOT NULL")
def q36_changed_paths(spark, sf_dir):
    return changes.changed_paths(_changes(spark, sf_dir))


@query("SELECT user_id, event_type, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q37_latest_state_upsert(spark, sf_dir):
    return changes.latest(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "value", "ts")


_JOBS_SQL = """
j AS (
  SELECT user_id, list(CASE event_type WHEN 'signup' THEN 'e' WHEN 'click' THEN 'c' WHEN 'error' THEN 'f' ELSE 'd' END ORDER BY ts, event_id) AS log
  FROM events WHERE event_type <> 'view' GROUP BY user_id),
fold AS (
  SELECT user_id, list_reduce(log, lambda s, k : CASE
    WHEN k.x = 'e' THEN {'x': '', 's': 'pending', 'a': 0}
    WHEN k.x = 'c' AND s.s = 'pending' THEN {'x': '', 's': 'processing', 'a': s.a + 1}
    WHEN k.x = 'f' AND s.s = 'processing' AND s.a >= 3 THEN {'x': '', 's': 'failed', 'a': s.a}
    WHEN k.x = 'f' AND s.s = 'processing' THEN {'x': '', 's': 'pending', 'a': s.a}
    WHEN k.x = 'd' AND s.s = 'processing' THEN {'x': '', 's': 'done', 'a': s.a} ELSE s END, {'x': '', 's': 'none', 'a': 0}) AS r
  FROM (SELECT user_id, list_transform(log, lambda x : {'x': x, 's': '', 'a': 0}) AS log FROM j))"""


@query(f"WITH {_JOBS_SQL} SELECT r.s AS status, count(*)::BIGINT AS n FROM fold WHERE r.s <> 'none' GROUP BY 1")
def q38_job_fsm_counts(spark, sf_dir):
    return _jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.fold_jobs(t.job_events(spark, sf_dir), "user_id", ["ts", "event_id"], "kind")


@query(f"WITH {_JOBS_SQL} SELECT user_id, r.s AS status, r.a::BIGINT AS attempts FROM fold WHERE r.s <> 'none' AND r.a >= 2")
def q39_job_retry_exhausted(spark, sf_dir):
    return _jobs(spark, sf_dir).filter("attempts >= 2").select("user_id", "status", "attempts")


@query(f"""WITH {_WINDOWS_SQL},
x AS (SELECT doc_id, count(*) AS expected FROM w GROUP BY 1), y AS (SELECT doc_id, count(*) AS actual FROM w JOIN labels USING (doc_id) GROUP BY 1)
SELECT doc_id, expected::BIGINT AS expected, coalesce(actual, 0)::BIGINT AS actual FROM x LEFT JOIN y USING (doc_id) WHERE expected <> coalesce(actual, 0)""")
def q40_drift_report(spark, sf_dir):
    expected = t.doc_windows(spark, sf_dir).select("doc_id")
    return state.drift(expected, expected.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"), "doc_id")


@query("""
WITH f AS (
  SELECT user_id AS file_path, arg_max(event_type, {'t': ts, 'i': event_id}) AS last, max(ts) AS indexed_at FROM events GROUP BY 1),
r AS (SELECT *, CASE WHEN last = 'error' THEN 'failed' WHEN last = 'click' THEN 'dirty' END AS reason FROM f)
SELECT file_path, reason, indexed_at FROM r WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY reason ORDER BY indexed_at, file_path) <= CASE WHEN reason = 'failed' THEN 100 ELSE 200 END""")
def q41_repair_candidates(spark, sf_dir):
    last = changes.latest(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")])
    files = last.select(F.col("user_id").alias("file_path"), F.when(F.col("event_type") == "error", "failed").otherwise("indexed").alias("status"), (F.col("event_type") == "click").alias("dirty"), F.col("ts").alias("indexed_at"))
    return state.repair_candidates(files).select("file_path", "reason", "indexed_at")


@query("SELECT doc_id AS file_path FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT least(200, greatest(1, (SELECT count(*) // 5 FROM documents)))")
def q42_deterministic_sample(spark, sf_dir):
    return state.sample_files(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_path")), 0.2, 200)


@query("""
WITH n AS (SELECT unnest(['code_ts', 'code_ts_desc', 'code_cs', 'code_cs_desc', 'docs', 'issues']) AS collection),
p AS (SELECT CASE lang WHEN 'en' THEN 'docs' WHEN 'fr' THEN 'code_ts' WHEN 'de' THEN 'code_cs' ELSE 'issues' END AS collection FROM documents)
SELECT collection, count(p.collection)::BIGINT AS n FROM n LEFT JOIN p USING (collection) GROUP BY 1""")
def q43_stats_by_collection(spark, sf_dir):
    return state.collection_counts(table(spark, sf_dir, "documents").select(t.mapped(F.col("lang"), {"en": "docs", "fr": "code_ts", "de": "code_cs", "es": "issues"}).alias("collection")))


# ---- evaluation, rerank, prompts


def _ranked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents by their score: a query's ranked list for every source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("query"))
    scored = _bm25(spark, sf_dir).join(docs, "doc_id").select("query", F.col("doc_id").alias("item"), "score")
    return retrieval.ranked(scored, "item", ["query"])


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(good, "doc_id").select(F.col("source").alias("query"), F.col("doc_id").alias("item"))


_EVAL_SQL = f"""{_bm25_sql(True)},
rk AS (SELECT source AS query, doc_id AS item, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM bm JOIN documents USING (doc_id)),
rel AS (SELECT DISTINCT doc_id AS item FROM labels WHERE quality = 1)"""


@query(f"WITH {_EVAL_SQL} SELECT query, round(count(rel.item) / 5, 6) AS precision FROM rk LEFT JOIN rel USING (item) WHERE rank <= 5 GROUP BY query")
def q44_eval_p_at_5(spark, sf_dir):
    return evaluation.precision_at(_ranked_docs(spark, sf_dir), _relevant(spark, sf_dir), 5)


@query(f"WITH {_EVAL_SQL} SELECT query, round(coalesce(1.0::DOUBLE / min(CASE WHEN rel.item IS NOT NULL THEN rank END), 0), 6) AS rr FROM rk LEFT JOIN rel USING (item) GROUP BY query")
def q45_eval_mrr(spark, sf_dir):
    return evaluation.reciprocal_rank(_ranked_docs(spark, sf_dir), _relevant(spark, sf_dir))


@query(f"""WITH {_EVAL_SQL},
pr AS (SELECT query, round(count(rel.item) / 5, 6) AS p FROM rk LEFT JOIN rel USING (item) WHERE rank <= 5 GROUP BY query),
rr AS (SELECT query, round(coalesce(1.0::DOUBLE / min(CASE WHEN rel.item IS NOT NULL THEN rank END), 0), 6) AS r FROM rk LEFT JOIN rel USING (item) GROUP BY query)
SELECT (SELECT round(avg(p), 6) FROM pr) AS precision_at_5, (SELECT round(avg(r), 6) FROM rr) AS mrr""")
def q45b_eval_means(spark, sf_dir):
    ranked, good = _ranked_docs(spark, sf_dir), _relevant(spark, sf_dir)
    p = evaluation.mean(evaluation.precision_at(ranked, good, 5), "precision", "precision_at_5")
    return p.crossJoin(evaluation.mean(evaluation.reciprocal_rank(ranked, good), "rr", "mrr"))  # a row each


@query(r"""
SELECT doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')), ['thing', 'with', 'the', 'retion', 'that']))::BIGINT AS rerank_score
FROM documents ORDER BY rerank_score DESC, doc_id LIMIT 50""")
def q46_rerank_overlap(spark, sf_dir):
    return retrieval.rerank_overlap(table(spark, sf_dir, "documents"), "thing with the retion that", "text", "doc_id", 50).select("doc_id", "rerank_score")


@query(f"""
SELECT doc_id, md5('Viết 1-2 câu tiếng Việt mô tả nghiệp vụ (business semantics) của hàm/lớp dưới đây.' || chr(10) || 'Tập trung vào: làm gì theo góc nhìn nghiệp vụ, khi nào dùng đến.' || chr(10)
  || 'Không giải thích kỹ thuật, không nhắc tên biến/tên hàm.' || chr(10) || 'Chỉ trả về 1-2 câu tiếng Việt, không thêm dấu trích dẫn, không markdown.' || chr(10) || chr(10)
  || 'Tên: doc-' || doc_id || chr(10) || 'Loại: ' || source || chr(10) || 'Signature: ' || lang || chr(10) || 'Docstring: (không có)' || chr(10) || 'Code:' || chr(10) || substring({_STRIP}, 1, 500) || chr(10)) AS prompt_md5 FROM documents""")
def q47_prompt_build(spark, sf_dir):
    made = tx.prompt(F.concat(F.lit("doc-"), F.col("doc_id")), F.col("source"), F.col("lang"), F.lit(None).cast("string"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(made.cast("binary")).alias("prompt_md5"))


@query("""
SELECT conv_id, turn, md5(trim(regexp_replace(trim(trim('  "- ' || text || '`"' || chr(10), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '"''`'), '^[-•]+', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS cleaned_md5
FROM conversations""")
def q48_output_clean(spark, sf_dir):
    answer = F.concat(F.lit('  "- '), F.col("text"), F.lit('`"\n'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(tx.cleaned(answer).cast("binary")).alias("cleaned_md5"))


@query("""
WITH j AS (SELECT conv_id * 1000 + turn AS chunk_id, turn % 4 AS attempts, conv_id FROM conversations),
o AS (SELECT conv_id * 1000 + turn AS chunk_id, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS description FROM conversations WHERE conv_id % 5 <> 0)
SELECT j.chunk_id, CASE WHEN o.chunk_id IS NULL OR coalesce(description, '') <> '' THEN 'done' WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS status,
       CASE WHEN o.chunk_id IS NOT NULL AND coalesce(description, '') = '' THEN 'empty description' END AS error
FROM j LEFT JOIN o USING (chunk_id)""")
def q48b_description_outcomes(spark, sf_dir):
    """Claimed jobs after a worker: turns are jobs, those of every fifth conversation have lost their chunk, every third answer is empty."""
    turns = table(spark, sf_dir, "conversations").withColumn("chunk_id", F.col("conv_id") * 1000 + F.col("turn"))
    jobs = turns.select("chunk_id", F.lit("processing").alias("status"), (F.col("turn") % 4).alias("attempts"))
    answers = turns.filter("conv_id % 5 <> 0").select("chunk_id", F.lit(True).alias("found"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("description"), F.lit(None).cast("string").alias("error"))
    return state.described(jobs, answers).select("chunk_id", "status", "error")


@query("SELECT l_suppkey AS file_path, count(*)::BIGINT AS n, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS entities FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY 1")
def q49_group_by_file(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file_path"), "l_partkey")
    return lines.groupBy("file_path").agg(F.sort_array(F.collect_set("l_partkey")).alias("e")).select("file_path", F.size("e").cast("long").alias("n"), F.array_join(F.col("e").cast("array<string>"), ",").alias("entities"))


@query(f"WITH {_EDGES_SQL} SELECT src, dst, c AS confidence FROM e WHERE src NOT IN ({_SEED_LIST}) AND dst NOT IN ({_SEED_LIST})")
def q50_delete_cascade(spark, sf_dir):
    _, left = graph.without_nodes(t.nodes(spark, sf_dir), t.edges(spark, sf_dir), _seeds(spark).withColumnRenamed("seed", "node"), "node")
    return left.select("src", "dst", "confidence")


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x01_tumbling(spark, sf_dir):
    bucket = F.window("ts", "10 minutes")
    return table(spark, sf_dir, "events").groupBy(bucket, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


@query("""
WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS session_start, count(*)::BIGINT AS n FROM s GROUP BY user_id, session""")
def x02_session(spark, sf_dir):
    gap = F.session_window("ts", "30 minutes")
    return table(spark, sf_dir, "events").groupBy("user_id", gap).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), "n")


@query(f"WITH {_JOBS_SQL} SELECT user_id, r.s AS status, r.a::BIGINT AS attempts FROM fold WHERE r.s <> 'none'")
def x03_stream_vs_batch(spark, sf_dir):
    """The job log as a file stream through the state machine; its end state must be the batch fold's."""
    from tessera.streaming import jobs
    from tessera.workspace import scratch

    events = t.job_events(spark, sf_dir)
    source, out, log = (scratch(spark, x) for x in ("events", "jobs", "log"))
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    jobs.run_available(jobs.job_stream(stream, "user_id", ["ts", "event_id"], "kind"), jobs.upserts(out, ["user_id"]), log)
    return jobs.read_latest(spark, out, ["user_id"]).select("user_id", "status", "attempts")
