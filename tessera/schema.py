"""Fixed values and table schemas of the engine."""

from pyspark.sql import types as T

# Limits, confidences and predicates that results depend on.
RRF_K = 60
TOP_K = 10
WINDOW_CHARS, WINDOW_OVERLAP = 1200, 150
BM25_K1, BM25_B = 1.2, 0.75
MAX_HOPS, GRAPH_LIMIT, CO_CHANGE_LIMIT, COMMIT_LIMIT, ISSUE_LIMIT = 4, 25, 8, 5, 20
MIN_COUNT, MAX_COMMIT_FILES, LOOKBACK = 3, 30, 500
MAX_ATTEMPTS = 3
LEASE_SECONDS = 600
DEFAULT_CONFIDENCE = 0.5
CONFIDENCE = {"call_name": 0.9, "call_member": 0.5, "heritage": 0.7, "import": 0.8, "same_file": 0.9, "imported": 0.7, "unique_name": 0.5, "semantic": 1.0}
EMBEDDABLE = ("function", "method", "class", "interface")
COLLECTIONS = ("code_ts", "code_ts_desc", "code_cs", "code_cs_desc", "docs", "issues")
DEFAULT_COLLECTIONS = COLLECTIONS[:5]
#: Collections of natural language; the others hold code.
TEXT_COLLECTIONS = ("code_ts_desc", "code_cs_desc", "docs", "issues")
SOURCE_SUFFIXES = ("ts", "tsx", "js", "jsx", "mts", "cts", "cs")
DOC_SUFFIXES = ("md", "markdown", "txt")
SKIPPED_FOLDERS = ("/node_modules/", "/dist/", "/bin/", "/obj/", "/.git/")
#: Fields of a packed hit, in this order.
HIT_FIELDS = (
    "chunk_id", "qualified_name", "symbol_name", "symbol_type", "language", "content", "title", "file_path", "line_start", "line_end",
    "repo", "source_type", "source_reliability", "matched_via", "matched_collection", "score", "rerank_score",
)

ENTITY = T.StructType([
    T.StructField("qualified_name", T.StringType()), T.StructField("name", T.StringType()), T.StructField("symbol_type", T.StringType()), T.StructField("file_path", T.StringType()),
    T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("signature", T.StringType()),
    T.StructField("docstring", T.StringType()), T.StructField("parent_class", T.StringType()), T.StructField("language", T.StringType()),
])
RELATION = T.StructType([
    T.StructField("from_qn", T.StringType()), T.StructField("to_name", T.StringType()), T.StructField("rel_type", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("resolution_type", T.StringType()), T.StructField("to_qn", T.StringType()),
])
PARSED = T.StructType([
    T.StructField("file_path", T.StringType()), T.StructField("language", T.StringType()), T.StructField("entities", T.ArrayType(ENTITY)),
    T.StructField("relations", T.ArrayType(RELATION)), T.StructField("error", T.StringType()),
])
CSHARP_ENTITY = "qualified_name string, name string, type string, class_name string, namespace string, file_path string, line_start int, line_end int, content string, signature string, visibility string, is_async boolean, return_type string, docstring string"
CSHARP_RELATION = "`from` string, `to` string, type string, confidence double, resolution_type string"
CSHARP_RESULT = f"entities array<struct<{CSHARP_ENTITY.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>>, relations array<struct<{CSHARP_RELATION.replace(' string', ':string').replace(' double', ':double')}>>"

#: Columns of the engine's tables that are read before anything was written to them.
_POSTING = "chunk_id string, collection string, file_path string, stamp string, dl int"
TABLES = {
    "sources": "file_path string, content string, stamp string",
    "entities": "file_path string, name string, qualified_name string, symbol_type string, line_start int, line_end int, content string, signature string, docstring string, parent_class string, language string, ordinal int, repo string, chunk_id string",
    "relations": "file_path string, from_qn string, to_name string, rel_type string, confidence double, resolution_type string, to_qn string, ordinal int",
    "edges": "src string, rel_type string, dst string, confidence double, resolution_type string, file_path string",
    "file_index": "file_path string, repo string, content_hash string, status string, chunk_ids array<string>, node_ids array<string>, error string, dirty boolean, indexed_at timestamp",
    "jobs": "file_path string, chunk_id string, qualified_name string, language string, repo string, status string, attempts bigint, enqueued_at timestamp, claimed_at timestamp, error string",
    "lengths": _POSTING,
    "postings": f"term string, {_POSTING}, tf bigint",
    "identifiers": "token string, file_path string, stamp string",
    "intents": "operation_id string, at timestamp, state string, kind string, file_path string, error string",
    "commits": "hash string, author string, date timestamp, message string, n_files bigint",
    "touches": "file_path string, hash string, date timestamp",
    "pairs": "file_a string, file_b string, count bigint, last_seen timestamp",
    "issues": "chunk_id string, issue_id string, title string, status string, source_reliability string",
}
