"""Sparse and dense scoring and per-collection hybrid search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import query_terms, tokens
from tessera.functions.vectors import cosine
from tessera.operators.fusion import rrf_merge
from tessera.schema import BM25_B, BM25_K1, RRF_K
from tessera.sources.store import MOST_FOLDERS, Tables
from tessera.workspace import scratch


#: Folders that postings are dealt to by term, for each partition of the texts; a query reads its terms' folders only.
FOLDERS_EACH = 4


def counted_terms(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(term, key, dl, kept columns, tf) of every term of every row, without a shuffle: a row's sorted tokens are cut where they change."""
    toks = docs.select(key, *keep, F.sort_array(tokens(F.col(text))).alias("__t")).withColumn("dl", F.size("__t"))
    first = F.transform("__t", lambda t, i: F.when((i == 0) | (t != F.get("__t", i - 1)), i))
    runs = toks.withColumn("__f", F.array_compact(first))
    counted = F.transform("__f", lambda at, j: F.struct(F.get("__t", at).alias("term"), (F.coalesce(F.get("__f", j + 1), F.col("dl")) - at).cast("long").alias("tf")))
    return runs.select(key, *keep, "dl", F.explode(counted).alias("__c")).select("__c.term", key, "dl", *keep, "__c.tf")


def postings(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(term, key, tf, dl, kept columns) of every term of every text; rows of one key and length count as one text."""
    return counted_terms(docs, key, text, keep).groupBy("term", key, "dl", *keep).agg(F.sum("tf").alias("tf"))


def corpus_statistics(docs: DataFrame, text: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, total_dl): how many texts there are, those without tokens too, and their tokens in all."""
    return docs.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(tokens(F.col(text)))), F.lit(0)).alias("total_dl"))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch of texts (key, tokens) its terms, each with lists of keys, lengths and frequencies: as long as the batch at most."""
    for batch in batches:
        keys, toks = batch.columns
        length = toks.value_lengths().to_numpy(zero_copy_only=False)
        coded = toks.flatten().dictionary_encode()
        both = (coded.indices.to_numpy().astype(np.int64) << 32) | np.repeat(np.arange(len(length)), length)
        both.sort()
        at = np.flatnonzero(np.diff(both, prepend=-1))  # a term's first place in a text
        tf, (term, of) = np.diff(at, append=len(both)), np.divmod(both[at], 1 << 32)
        heads = np.flatnonzero(np.diff(term, prepend=-1))
        ends = pa.array(np.append(heads, len(term)), pa.int32())
        columns = [keys.take(pa.array(of)), pa.array(length[of], pa.int32()), pa.array(tf, pa.int32())]
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term[heads])), *(pa.ListArray.from_arrays(ends, c) for c in columns)], names=["term", batch.schema.names[0], "dl", "tf"])


def term_lists(docs: DataFrame, key: str, text: str) -> DataFrame:
    """What counted_terms gives as a row for each term and Arrow batch of texts: lists of keys, dl and tf of one length. So a common term is not a row for each text."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, tokens(F.col(text)).alias("__t")).mapInArrow(_lists, f"term string, `{key}` array<{kind}>, dl array<int>, tf array<int>")


def write_postings(docs: DataFrame, path: str, key: str, text: str) -> None:
    """Postings in folders by term and the corpus statistics, each written once under path. The folders follow the texts' partitions.

    Texts are cut once, and postings move once, as lists by term, to their folders; only where a key stands in several
    rows are its postings added up before. The tokens in all are the sum of the frequencies.
    """
    tables = Tables(docs.sparkSession, path)
    twice = docs.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    rows = postings(docs, key, text).select("term", *(F.array(c).alias(c) for c in (key, "dl", "tf"))) if twice else term_lists(docs, key, text)
    lists = tables.put("terms", rows, "term", min(MOST_FOLDERS, FOLDERS_EACH * docs.rdd.getNumPartitions()))
    total = lists.select(F.explode("tf").alias("tf")).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total_dl"))  # reads this column only
    tables.put("corpus", docs.agg(F.count("*").alias("n")).crossJoin(total), "n", 1)  # a row each


def _unlisted(lists: DataFrame) -> DataFrame:
    return lists.select("term", F.inline(F.arrays_zip(*(c for c in lists.columns if c != "term")))).withColumn("tf", F.col("tf").cast("long"))


def read_postings(spark: SparkSession, path: str, terms: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings, of some terms' folders only, and the corpus statistics."""
    tables = Tables(spark, path)
    return _unlisted(tables.get("terms", terms)), tables["corpus"]


def write_asked(docs: DataFrame, path: str, key: str, text: str, terms: list[str]) -> None:
    """Some terms of every text: a row for each text, with its length and, as often as they stand there, these terms.

    For a few terms where there are no postings of all: texts are cut whole and once, and none of their other
    terms moves or is written.
    """
    cut = docs.select(key, tokens(F.col(text)).alias("__t"))
    cut.select(key, F.size("__t").alias("dl"), F.filter("__t", lambda t: t.isin(*terms)).alias("terms")).write.parquet(path)


def read_asked(docs: DataFrame, path: str, key: str) -> tuple[DataFrame, DataFrame]:
    """What read_postings gives of the terms that write_asked was asked for."""
    kept = docs.sparkSession.read.schema(f"`{key}` {docs.schema[key].dataType.simpleString()}, dl int, terms array<string>").parquet(path)
    rows = kept.select(F.explode("terms").alias("term"), key, "dl").groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    return rows, kept.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_dl"))


def bm25_postings(rows: DataFrame, corpus: DataFrame, terms: list[str], key: str, idf: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, key, score) of the texts that hold a term, from postings; by: what makes a corpus of its own, such as the collection.

    A term's frequency over all texts is its number of rows; there are as many of these counts as query
    terms and corpora. No terms, no rows.
    """
    terms = sorted(set(terms))
    hits = rows.filter(F.col("term").isin(*terms)) if terms else rows.filter(F.lit(False))
    held = F.broadcast(hits.groupBy(*by, "term").agg(F.count("*").alias("df")))  # a row for each query term and corpus
    stats = F.broadcast(corpus.select(*by, "n", (F.col("total_dl") / F.nullif(F.col("n"), F.lit(0))).alias("avg_dl")))  # a row for each corpus
    met = hits.join(held, [*by, "term"])
    met = met.join(stats, list(by)) if by else met.crossJoin(stats)
    part = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avg_dl")))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) if idf else F.lit(1.0)
    return met.groupBy(*by, key).agg(F.round(F.sum(weight * part), 6).alias("score"))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.coalesce(1).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bm25_many(rows: DataFrame, corpus: DataFrame, queries: DataFrame, key: str, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query, key, score, rank) of the k best texts of each of many queries (query, text), in one job with the query as a key.

    Queries meet the postings by term; a term's frequency is counted once for all of them. The queries' terms
    are written first, so that Spark knows their size: where they are few the postings stay where they are, and
    what moves is a sum for each query and text. A query without terms that any text holds has no rows.
    """
    spark = rows.sparkSession
    cut = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    named = _written(cut.select("term").distinct(), scratch(spark, "asked-terms"))
    often = rows.join(named, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    asked = _written(cut.join(often, "term"), scratch(spark, "asked"))
    stats = F.broadcast(corpus.select("n", (F.col("total_dl") / F.nullif(F.col("n"), F.lit(0))).alias("avg_dl")))  # one row
    part = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avg_dl")))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    met = rows.join(asked, "term").crossJoin(stats).select("query", key, *keep, (weight * part).alias("part"))
    summed = met.groupBy("query", key, *keep).agg(F.round(F.sum("part"), 6).alias("score"))
    return ranked(summed, key, ["query"]).filter(F.col("rank") <= k)


def _equals(term: str, x: Column) -> Column:
    return x == term


def bm25(docs: DataFrame, terms: list[str], key: str, text: str, idf: bool = True, corpus: DataFrame | None = None) -> DataFrame:
    """(key, score) of the rows that hold a term, without an index; Okapi BM25, or without idf the plain sparse product. No terms, no rows.

    Query terms are few, so their frequencies are columns: one pass gives the corpus statistics as one
    row, a second the scores, and nothing but that row moves. corpus: what the statistics are taken
    over, if it is more than docs.
    """
    terms = list(dict.fromkeys(terms))

    def counted(df: DataFrame) -> DataFrame:
        toks = df.withColumn("__t", tokens(F.col(text)))
        tf = [F.size(F.filter("__t", partial(_equals, t))).alias(f"__tf{i}") for i, t in enumerate(terms)]
        return toks.select(F.col(key), F.size("__t").alias("__dl"), *tf)

    rows = counted(docs)
    over = rows if corpus is None else counted(corpus)
    stats = over.agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *(F.sum((F.col(f"__tf{i}") > 0).cast("long")).alias(f"__df{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"__tf{i}"), F.col(f"__df{i}")
        part = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("__dl") / F.col("__avg")))
        score = score + (F.log(1 + (F.col("__n") - df + 0.5) / (df + 0.5)) * part if idf else part)
    any_term = F.greatest(*(F.col(f"__tf{i}") for i in range(len(terms))), F.lit(0), F.lit(0))
    return rows.filter(any_term > 0).crossJoin(F.broadcast(stats)).select(key, F.round(score, 6).alias("score"))  # stats is one row


def knn(points: DataFrame, query: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, score) of every point by cosine to the one query vector in `query`.`vector`."""
    q = query.select(F.col(vector).alias("__q")).limit(1)
    return points.crossJoin(F.broadcast(q)).select(key, cosine(F.col(vector), F.col("__q")).alias("score"))


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    return scored.orderBy(F.col("score").desc(), key).limit(k)


def ranked(scored: DataFrame, key: str, partition: list[str] | None = None) -> DataFrame:
    order = Window.partitionBy(*(partition or [])).orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(order))


def over_fetch(k: int) -> int:
    return max(30, 3 * k)


def hybrid_by(sparse: DataFrame, dense: DataFrame, by: str, key: str, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """(by, key, score) of hybrid() within each value of `by` at once: each list and each result cut to k there."""
    lists = None
    for number, scored in enumerate((dense, sparse)):
        cut = ranked(scored.select(by, key, "score"), key, [by]).filter(F.col("rank") <= k).select(by, key, "rank", F.lit(number).alias("list_no"))
        lists = cut if lists is None else lists.unionByName(cut)
    both = lists.groupBy(by, key).agg(F.round(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "first", key)
    return both.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= k).select(by, key, "score")


def hybrid(sparse: DataFrame, dense: DataFrame, key: str, k: int, rrf_k: int = RRF_K, rank_base: int = 1) -> DataFrame:
    """Top rows of two scored lists by reciprocal ranks, each list cut to over_fetch(k) first."""
    n = over_fetch(k)
    lists = None
    for number, scored in enumerate((dense, sparse)):
        cut = ranked(top(scored.select(key, "score"), key, n), key).withColumn("list_no", F.lit(number)).drop("score")
        lists = cut if lists is None else lists.unionByName(cut)
    return rrf_merge(lists, key, rrf_k, rank_base).orderBy(F.col("score").desc(), "list_no", "rank", key).limit(k)


def rerank_overlap(hits: DataFrame, query: str, text: str, key: str, k: int) -> DataFrame:
    """Hits by how many distinct query tokens they hold: the stand-in for a cross-encoder."""
    words = F.array(*map(F.lit, query_terms(hits.sparkSession, query))).cast("array<string>")
    overlap = F.size(F.array_intersect(F.array_distinct(tokens(F.col(text))), words)).cast("long")
    return hits.withColumn("rerank_score", overlap).orderBy(F.col("rerank_score").desc(), key).limit(k)


def rerank_with(hits: DataFrame, score, query: str, text: str, key: str, k: int) -> DataFrame:
    """Hits by another scorer: score(query, texts) gives a number for each of a list of texts. Where it fails or gives none the hits keep their order, at the end."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series([None if x is None else float(x) for x in score(query, [t or "" for t in texts])], index=texts.index, dtype="float64")
        except Exception:  # any scorer's fault: the search goes on without it
            return pd.Series([None] * len(texts), index=texts.index, dtype="float64")

    return hits.withColumn("rerank_score", scores(text)).orderBy(F.col("rerank_score").desc_nulls_last(), F.col("score").desc(), key).limit(k)


def lookup_symbol(entities: DataFrame, name: str, limit: int = 1) -> DataFrame:
    """The entities of exactly this qualified name, else of this short name, in order of their qualified names."""
    whole, short = F.col("qualified_name") == name, F.col("name") == name
    return entities.filter(whole | short).orderBy(whole.desc(), "qualified_name").limit(limit)
