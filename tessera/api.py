"""The engine as one object over its tables: indexing, search, graph lookups, changes, upkeep.

A change of files writes the folders of their tables that hold these files (sources.store), and appends
to the indexes of terms and identifiers, so its cost follows the files and not the corpus. Every step works
on a batch of files as joins and unions; a file that fails is a row with an error and keeps no other file
from being indexed. Files are named by one path key (functions.text.normal_path).
"""

from __future__ import annotations

import functools
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.vectors import cosine, hashed_embedding
from tessera.operators import changes, cochange, evaluation, filters, fusion, graph, pack, resolve, retrieval, state, vector_index
from tessera.schema import CO_CHANGE_LIMIT, COLLECTIONS, COMMIT_LIMIT, DEFAULT_COLLECTIONS, DOC_SUFFIXES, LEASE_SECONDS, MAX_COMMIT_FILES, MAX_HOPS, MIN_COUNT, TABLES, TEXT_COLLECTIONS, TOP_K
from tessera.sources import code, store
from tessera.sources.files import scan_docs, scan_repo
from tessera.workspace import children, exists, remove, scratch

_CODE = ("code_ts", "code_cs")
_OUTCOME = "outcome string, file_path string, error string"


def clamp(value: int, least: int, most: int) -> int:
    return max(least, min(most, value))


def _stamped_id() -> Column:
    """A chunk as it was written by one operation; a later write of it is another."""
    return F.concat_ws("@", "stamp", "chunk_id")


def _chunk_of(stamped: str) -> Column:
    return F.expr(f"substring({stamped}, locate('@', {stamped}) + 1)")  # stamps are hexadecimal


def unit(method):
    """A method whose tables written aside are removed at its end; the DataFrame that it returns is kept, written out."""

    @functools.wraps(method)
    def run(self, *args, **kwargs):
        if self._aside is not None:  # within another unit
            return method(self, *args, **kwargs)
        self._aside = []
        try:
            result = method(self, *args, **kwargs)
            return self._kept(result) if isinstance(result, DataFrame) else result
        finally:
            for path in self._aside:
                remove(self.spark, path)
            self._aside = None

    return run


@dataclass
class Engine:
    """root: the folder of all tables; a new scratch folder if not given. embed and embed_text: from a token array to a vector, for code and for natural language.

    Tables: sources (file_path, content, stamp), entities, relations (as parsed), edges (src, dst, rel_type, confidence, file_path), file_index, doc_index, documents, jobs,
    lengths (of chunks by collection), commits, touches, pairs, issues: in folders by file, commits and issues by their own keys; postings by term, identifiers by token and
    the intent log, which are appended to. Points (collection, chunk_id, content, dense, ...) lie beside them. A posting counts if a length has its stamp, an identifier if its source has.
    """

    spark: SparkSession
    root: str | None = None
    embed: object = hashed_embedding
    embed_text: object = hashed_embedding
    _aside: list | None = field(default=None, repr=False)

    def __post_init__(self):
        self.root = self.root or scratch(self.spark, "engine")
        self.tables, self.points = store.Tables(self.spark, f"{self.root}/tables"), f"{self.root}/points"

    def _once(self, df: DataFrame) -> DataFrame:
        """df written aside until the unit ends, so that what is derived from it is derived once."""
        path = scratch(self.spark, "aside")
        self._aside.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _kept(self, df: DataFrame) -> DataFrame:
        path = scratch(self.spark, "outcome")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _table(self, name: str) -> DataFrame:
        """The table, or an empty one of its columns where nothing was written yet."""
        found = self.tables.get(name)
        return self.spark.createDataFrame([], TABLES[name]) if found is None else found

    def _append(self, name: str, rows: DataFrame, key: str, live) -> None:
        """Adds rows to an index table; after some such writes it is put anew with live(table)."""
        if self.tables.append(name, rows, key):
            self.tables.put(name, live(self.tables[name]), key)

    def _live_postings(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._table("lengths").select("collection", "chunk_id", "stamp"), ["collection", "chunk_id", "stamp"], "left_semi")

    def _live_identifiers(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._table("sources").select("file_path", "stamp"), ["file_path", "stamp"], "left_semi")

    def _log(self, files: DataFrame, operation: str, kind: str, to: str) -> None:
        self._append("intents", state.intents(files, operation, kind, to), "file_path", lambda log: log)

    def _outcomes(self, *parts: tuple[str, DataFrame]) -> DataFrame:
        out = self.spark.createDataFrame([], _OUTCOME)
        for outcome, rows in parts:
            error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
            out = out.unionByName(rows.select(F.lit(outcome).alias("outcome"), "file_path", error.alias("error")))
        return out

    @staticmethod
    def summary(outcomes: DataFrame) -> DataFrame:
        """(outcome, n) of the rows that indexing, changes and repair give."""
        return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))

    # ---- indexing

    @unit
    def index_repo(self, root: str, repo: str = "repo") -> DataFrame:
        """All source files and documents under a folder."""
        outcomes = self.index_files(scan_repo(self.spark, root).select("file_path", "content"), repo)
        return outcomes.unionByName(self.index_docs(scan_docs(self.spark, root), repo=repo))

    @unit
    def index_files(self, files: DataFrame, repo: str = "repo", kind: str = "MODIFIED") -> DataFrame:
        """Parses source files (file_path, content) and replaces what the tables hold of them. Outcomes (indexed or failed, file_path, error).

        A file that cannot be parsed gets a failed row in file_index and leaves its other rows as they were. Of
        several rows of one file the one of the greatest content counts.
        """
        files = self._once(code.routed(self._each_once(files, "content")))
        if not files.limit(1).count():
            return self._outcomes()
        parsed = self._once(code.parse_sources(files.filter("reader = 'scanner'")))
        other = files.filter("reader != 'scanner'").select("file_path", F.concat(F.lit("unsupported here, reader: "), "reader").alias("error"))
        bad = parsed.filter("error is not null").select("file_path", "error").unionByName(other)
        return self._written(files.select("file_path", "content"), code.entities_of(parsed), code.relations_of(parsed), bad, repo, kind)

    @staticmethod
    def _each_once(files: DataFrame, text: str) -> DataFrame:
        return files.groupBy("file_path").agg(F.max(text).alias(text))

    @unit
    def index_csharp(self, exported: DataFrame, files: DataFrame, repo: str = "repo") -> DataFrame:
        """Exported analyses (json) of C# files (file_path, content): like index_files. A file without an entity is failed."""
        entities, relations = code.csharp_results(exported)
        order = F.row_number().over(changes.Window.partitionBy("file_path").orderBy("line_start", "qualified_name")) - 1
        entities = self._once(entities.withColumn("ordinal", order))
        relations = relations.withColumn("ordinal", F.row_number().over(changes.Window.partitionBy("file_path").orderBy("from_qn", "rel_type", "to_qn")) - 1)
        bad = files.join(entities, "file_path", "left_anti").select("file_path", F.lit("no analysis").alias("error"))
        return self._written(self._once(self._each_once(files, "content")), entities, relations, bad, repo, "MODIFIED")

    def _written(self, files: DataFrame, entities: DataFrame, relations: DataFrame, bad: DataFrame, repo: str, kind: str) -> DataFrame:
        """The one unit of indexing: intents, graph, points, postings, jobs, file states, and the intents' ends."""
        operation = uuid.uuid4().hex
        self._log(files, operation, kind, "intent")
        bad = self._once(bad.groupBy("file_path").agg(F.min(tx.shortened(F.col("error"))).alias("error")))
        good = self._once(files.join(bad, "file_path", "left_anti").select("file_path", "content", tx.content_hash(F.col("content")).alias("content_hash")))
        sources = files.select("file_path", "content", F.lit(operation).alias("stamp"))
        self.tables.change("sources", sources, files, ["file_path"])
        self._append("identifiers", changes.mentions(sources, ("stamp",)), "token", self._live_identifiers)
        named = entities.join(good.select("file_path"), "file_path", "left_semi").withColumns({
            "repo": F.lit(repo), "chunk_id": tx.chunk_id(F.lit(repo), F.col("qualified_name"), F.col("ordinal"))})
        named = self._once(named)
        everything = self.tables.change("entities", named, good, ["file_path"])
        self.tables.change("relations", self._once(relations.join(good.select("file_path"), "file_path", "left_semi")), good, ["file_path"])
        self._link(good.select("file_path"), everything)
        chunks = self._once(filters.embeddable(named).select(
            tx.collection_of(F.col("language")).alias("collection"), "chunk_id", "content", "file_path", "qualified_name", F.col("name").alias("symbol_name"), "symbol_type", "signature", "docstring",
            "parent_class", "line_start", "line_end", "language", "repo", F.lit("code").alias("source_type"), F.lit("high").alias("source_reliability"), F.lit(True).alias("is_latest"),
            F.lit("pending").alias("description_status"), F.lit(None).cast("string").alias("description_chunk_id"), F.lit(None).cast("string").alias("linked_chunk_id"),
        ).withColumn("dense", self.embed(tx.tokens(F.col("content")))))
        self._points(chunks, good, COLLECTIONS[:4], operation)
        jobs = chunks.select("file_path", "chunk_id", "qualified_name", "language", "repo", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempts"), F.current_timestamp().alias("enqueued_at"), F.lit(None).cast("timestamp").alias("claimed_at"), F.lit(None).cast("string").alias("error"))
        self.tables.change("jobs", jobs, good, ["file_path"])
        ids = named.groupBy("file_path").agg(F.sort_array(F.collect_list("chunk_id")).alias("node_ids"))
        chunk_ids = chunks.groupBy("file_path").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))
        none = F.array().cast("array<string>")
        rows = good.join(ids, "file_path", "left").join(chunk_ids, "file_path", "left").select(
            "file_path", F.lit(repo).alias("repo"), "content_hash", F.lit("indexed").alias("status"), F.coalesce("chunk_ids", none).alias("chunk_ids"), F.coalesce("node_ids", none).alias("node_ids"), F.lit(None).cast("string").alias("error"))
        broken = files.join(bad, "file_path").select(
            "file_path", F.lit(repo).alias("repo"), tx.content_hash(F.col("content")).alias("content_hash"), F.lit("failed").alias("status"), none.alias("chunk_ids"), none.alias("node_ids"), "error")
        written = self._once(state.stamped(rows.unionByName(broken)))
        self.tables.change("file_index", written, written, ["file_path"])
        self._log(good, operation, kind, "done")
        self._log(bad, operation, kind, "failed")
        return self._outcomes(("indexed", good), ("failed", bad))

    def _link(self, files: DataFrame, entities: DataFrame) -> None:
        """Resolves the relations of files against all entities and puts the edges, DEFINES too, in place of theirs. An edge's source must exist."""
        own = self.tables["relations"].join(files, "file_path", "left_semi")
        linked = resolve.cross_file(resolve.same_file(own, entities), entities).select(
            F.col("from_qn").alias("src"), F.coalesce("to_qn", "to_name").alias("dst"), "rel_type", "confidence", "resolution_type", "file_path", "ordinal")
        merged = graph.merge_edges(linked, ["file_path", "ordinal"], values=("confidence", "resolution_type", "file_path"))
        defined = resolve.defines(entities.join(files, "file_path", "left_semi")).withColumns({
            "confidence": F.lit(1.0), "resolution_type": F.lit("definition"), "file_path": F.col("src")})
        edges = self._once(graph.real_edges(merged.unionByName(defined), entities, "qualified_name"))
        self.tables.change("edges", edges, files, ["file_path"])

    def _points(self, chunks: DataFrame, files: DataFrame, collections: tuple[str, ...], stamp: str) -> None:
        """Chunks in place of the files' points in these collections, and their postings."""
        store.replace_points(chunks, files, self.points, collections)
        names = self.spark.createDataFrame([(c,) for c in collections], "collection string")  # six at most
        self._search_tables(chunks, files.select("file_path").distinct().crossJoin(F.broadcast(names)), ["file_path", "collection"], stamp)

    def _search_tables(self, chunks: DataFrame, gone: DataFrame, on: list[str], stamp: str) -> None:
        stamped = chunks.withColumn("stamp", F.lit(stamp))
        rows = retrieval.postings(stamped, "chunk_id", "content", ("collection", "file_path", "stamp"))
        self.tables.change("lengths", stamped.select("collection", "file_path", "chunk_id", F.size(tx.tokens(F.col("content"))).alias("dl"), "stamp"), gone, on)
        self._append("postings", rows, "term", self._live_postings)

    @unit
    def index_docs(self, docs: DataFrame, language: str = "vi", repo: str = "repo") -> DataFrame:
        """Cuts documents (file_path, text) into chunks of the docs collection, with document nodes and doc_index rows. Outcomes as of index_files; other suffixes fail."""
        operation = uuid.uuid4().hex
        docs = self._once(self._each_once(docs, "text"))
        if not docs.limit(1).count():
            return self._outcomes()
        known = tx.suffix(F.col("file_path")).isin(*DOC_SUFFIXES, "html") & F.col("text").isNotNull()
        good, bad = docs.filter(known), docs.filter(~known).select("file_path", F.concat(F.lit("unsupported document type: "), tx.suffix(F.col("file_path"))).alias("error"))
        self._log(docs, operation, "DOC_MODIFIED", "intent")
        made = self._once(tx.chunks(good, ["file_path"], "text").withColumns({
            "collection": F.lit("docs"), "chunk_id": tx.chunk_id(F.lit(repo), F.col("file_path"), F.col("chunk_index")), "language": F.lit(language), "repo": F.lit(repo), "source_type": F.lit("doc"),
            "source_reliability": F.lit("high"), "is_latest": F.lit(True), "linked_chunk_id": F.lit(None).cast("string"), "dense": self.embed_text(tx.tokens(F.col("content")))}))
        self._points(made, good, ("docs",), operation)
        self.tables.change("documents", made.select("chunk_id", "title", "file_path", "repo", "line_start", "line_end", "is_latest"), good, ["file_path"])
        ids = made.groupBy("file_path").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))
        self.tables.change("doc_index", good.join(ids, "file_path", "left").select(
            "file_path", tx.content_hash(F.col("text")).alias("content_hash"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"), F.lit(True).alias("is_latest"), F.current_timestamp().alias("indexed_at")), good, ["file_path"])
        self._log(good, operation, "DOC_MODIFIED", "done")
        self._log(bad, operation, "DOC_MODIFIED", "failed")
        return self._outcomes(("indexed", good), ("failed", bad))

    @unit
    def delete_files(self, files: DataFrame) -> None:
        """Takes files (file_path) out of every table; their file_index rows stay, marked as deleted."""
        gone = self._once(files.select("file_path").distinct())
        if not gone.limit(1).count():
            return
        nodes = self._table("entities").join(gone, "file_path", "left_semi")
        lost = self._once(nodes.select(F.col("qualified_name").alias("node"), "chunk_id"))
        edge, edges = ["file_path", "src", "rel_type", "dst"], self._table("edges")
        left = edges.join(gone, "file_path", "left_semi").select(edge).unionByName(edges.join(lost, edges["dst"] == lost["node"], "left_semi").select(edge))
        self.tables.change("edges", None, self._once(left), edge)
        store.delete_points(gone, self.points)
        for name in ("entities", "relations", "sources", "jobs", "documents", "doc_index", "touches", "lengths"):
            self.tables.change(name, None, gone, ["file_path"])
        pairs = self._table("pairs").select("file_a", "file_b")
        ended = [pairs.join(gone.withColumnRenamed("file_path", side), side, "left_semi").select("file_a", "file_b") for side in ("file_a", "file_b")]
        self.tables.change("pairs", None, self._once(ended[0].unionByName(ended[1])), ["file_a", "file_b"])
        self.tables.change("issues", None, lost, ["chunk_id"])
        marked = self._once(state.soft_deleted(self._table("file_index").join(gone, "file_path", "left_semi"), gone))
        self.tables.change("file_index", marked, gone, ["file_path"])

    @unit
    def index_history(self, commits: DataFrame) -> None:
        """Adds commits (hash, author, date, message, files) to the history of the modules there are: touches and co-change pairs.

        Commits come in any order and number of calls, and more than once. Pairs of files that new touches are
        about are counted again from all their commits, mass commits aside. Other columns may lack or be null.
        """
        given = commits.select(*(F.col(c) if c in commits.columns else F.lit(None).cast("string").alias(c) for c in ("hash", "author", "date", "message", "files")))
        files = given.select("hash", "date", F.explode("files").alias("file_path")).filter(filters.indexed_source(F.col("file_path"))).distinct()
        new_commits = self._once(given.filter("hash IS NOT NULL").groupBy("hash").agg(*(F.max(c).alias(c) for c in ("author", "date", "message"))).join(files.groupBy("hash").agg(F.count("*").alias("n_files")), "hash"))
        self.tables.change("commits", new_commits, new_commits, ["hash"], "hash")
        modules = self._table("entities").filter("symbol_type = 'module'").select("file_path").distinct()
        known = self._table("touches").select("file_path", "hash")
        new = self._once(files.join(modules, "file_path", "left_semi").join(known, ["file_path", "hash"], "left_anti").groupBy("file_path", "hash").agg(F.max("date").alias("date")))
        self.tables.change("touches", new, new, ["file_path", "hash"])
        about, touches = new.select("file_path").distinct(), self._table("touches")
        counted = self._table("commits").filter(F.col("n_files") <= MAX_COMMIT_FILES).select("hash")
        again = touches.join(about, "file_path", "left_semi").select("hash").distinct().join(counted, "hash", "left_semi")
        rows = touches.join(again, "hash", "left_semi").select(F.col("hash").alias("commit"), F.col("file_path").alias("file"), "date")
        pairs = cochange.co_change_pairs(rows, 1, None)
        either = [pairs.join(about.withColumnRenamed("file_path", side), side, "left_semi") for side in ("file_a", "file_b")]
        fresh = self._once(either[0].unionByName(either[1]).distinct())
        self.tables.change("pairs", fresh, fresh, ["file_a", "file_b"], "file_a")

    @unit
    def index_issues(self, references: DataFrame) -> None:
        """References (chunk_id, issue_id, maybe title, status, source_reliability) of issues to the chunks there are, added to those known; the last call's fields count."""
        points = store.read_points(self.spark, self.points)
        real = self.spark.createDataFrame([], "chunk_id string") if points is None else points.select("chunk_id")
        fields = [(F.max(c) if c in references.columns else F.lit(None).cast("string")).alias(c) for c in ("title", "status", "source_reliability")]
        rows = self._once(references.groupBy("chunk_id", "issue_id").agg(F.count("*").alias("n"), *fields).drop("n").join(real, "chunk_id", "left_semi"))
        self.tables.change("issues", rows, rows, ["chunk_id", "issue_id"], "chunk_id")

    @unit
    def apply_changes(self, changed: DataFrame, contents: DataFrame, repo: str = "repo") -> DataFrame:
        """Applies changes (status, path, old_path) given the new contents (file_path, content): outcomes (deleted, indexed, relinked or failed, file_path, error).

        Renames are a deletion and an addition. Files that anywhere hold a name which came or went have
        their relations resolved again, once; what that changes is not followed further.
        """
        changed = self._once(changed.select("status", "path", "old_path"))
        before = self._once(self._table("entities").select("file_path", "name").join(changes.changed_paths(changed).withColumnRenamed("path", "file_path"), "file_path", "left_semi"))
        gone = self._once(changed.filter("status in ('deleted', 'renamed')").select(F.coalesce("old_path", "path").alias("file_path")).distinct())
        new = contents.join(changed.filter("status != 'deleted'").select(F.col("path").alias("file_path")), "file_path", "left_semi")
        self.delete_files(gone)
        indexed = self.index_files(new, repo)
        done = self._once(changes.changed_paths(changed).withColumnRenamed("path", "file_path"))
        after = self._table("entities").select("file_path", "name").join(done, "file_path", "left_semi")
        names = self._once(changes.affected_names(changed, before, after))
        held = self.tables.get("identifiers", names)
        if held is None:
            return self._outcomes(("deleted", gone)).unionByName(indexed)
        relinked = self._once(changes.referencers(self._live_identifiers(held), names, done).join(self._table("relations").select("file_path").distinct(), "file_path", "left_semi"))
        if relinked.limit(1).count():
            self._link(relinked, self._table("entities"))
        return self._outcomes(("deleted", gone), ("relinked", relinked)).unionByName(indexed)

    def rename_file(self, old: str, new: str, content: str, repo: str = "repo") -> DataFrame:
        change = self.spark.createDataFrame([("renamed", new, old)], "status string, path string, old_path string")
        return self.apply_changes(change, self.spark.createDataFrame([(new, content)], "file_path string, content string"), repo)

    # ---- descriptions

    @unit
    def describe(self, generate, batch: int = 100, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
        """Works off the oldest pending jobs: outcomes (done, failed, pending or vanished, chunk_id, error). Claims older than a lease are released first: their worker is lost.

        generate: from a column of prompts to a column of answers, null or empty where it failed. Answers
        become points of the description collection; the code point and the entity learn of them.
        """
        job, points = ["file_path", "chunk_id"], store.read_points(self.spark, self.points, _CODE)
        if points is None:
            return self.spark.createDataFrame([], "outcome string, chunk_id string, error string")
        claimed = self._once(state.claim(state.released(self._table("jobs"), F.current_timestamp(), lease_seconds), batch).withColumn("claimed_at", F.current_timestamp()))
        self.tables.change("jobs", claimed, claimed, job)
        held = self._once(claimed.select("chunk_id").join(points, "chunk_id"))
        asked = held.withColumn("answer", generate(tx.prompt(F.col("symbol_name"), F.col("symbol_type"), F.col("signature"), F.col("docstring"), F.col("content"))))
        answered = self._once(asked.withColumn("description", tx.cleaned(F.col("answer"))).drop("answer"))
        outcomes = answered.select("chunk_id", F.lit(True).alias("found"), "description", F.lit(None).cast("string").alias("error"))
        ended = self._once(state.described(claimed, outcomes))
        good = answered.filter(F.coalesce("description", F.lit("")) != "").withColumn("id", tx.chunk_id(F.lit("description"), F.col("chunk_id")))
        described = self._once(good.withColumns({
            "linked_chunk_id": F.col("chunk_id"), "chunk_id": F.col("id"), "content": F.col("description"), "collection": F.concat("collection", F.lit("_desc")), "source_type": F.lit("code_description"),
            "description_status": F.lit("ready"), "dense": self.embed_text(tx.tokens(F.col("description")))}).drop("id", "description"))
        store.upsert_points(described, self.points)
        self._search_tables(described, described, ["file_path", "chunk_id", "collection"], uuid.uuid4().hex)
        store.patch_points(good.select("collection", "file_path", "chunk_id", F.lit("ready").alias("description_status"), F.col("id").alias("description_chunk_id")), self.points)
        told = self._once(good.select(*job, F.col("description").alias("synthetic_description_vi")))
        named = self._once(changes.patch(self._table("entities").join(told, job, "left_semi"), told, job))
        self.tables.change("entities", named, named, job)
        self.tables.change("jobs", ended, ended, job)
        found = held.select("chunk_id").withColumn("there", F.lit(True))
        return ended.join(found, "chunk_id", "left").select(F.when(F.col("there").isNull(), "vanished").otherwise(F.col("status")).alias("outcome"), "chunk_id", "error")

    # ---- search

    @unit
    def index_vectors(self, lists: int | None = None, recall: float = 0.95) -> None:
        """Writes an inverted file of the vectors of each collection, in place of earlier ones, for searches that are not exact.

        lists and recall as in vector_index.write_index. Later changes need not wait for the next call: a search
        leaves out what is no longer there, and takes exact cosines of what came since.
        """
        lengths = self._table("lengths")
        for c in COLLECTIONS:
            if (points := store.read_points(self.spark, self.points, (c,))) is None:
                continue
            stamps = lengths.filter(F.col("collection") == c).select("chunk_id", "stamp")
            folder = f"{self.root}/vectors/{c}"
            old, path = children(self.spark, folder), f"{folder}/{time.time_ns():020d}"
            stamps.select("stamp").distinct().write.parquet(f"{path}/stamps")
            vector_index.write_index(points.select("chunk_id", "dense").join(stamps, "chunk_id").select(_stamped_id().alias("id"), "dense"), path, "id", "dense", lists, recall=recall)
            for name in old:
                remove(self.spark, f"{folder}/{name}")

    def _vectors(self, collection: str) -> str | None:
        """The folder of a collection's inverted file; None before index_vectors()."""
        folder = f"{self.root}/vectors/{collection}"
        whole = [name for name in children(self.spark, folder) if exists(self.spark, f"{folder}/{name}/about.json")]
        return f"{folder}/{whole[-1]}" if whole else None

    def _near(self, points: DataFrame, collections: list[str], near, scored) -> DataFrame:
        """Scores of the points by collection: near(collection, folder, live ids) from its inverted file, and scored(collection, points) of the points that the file doesn't know."""
        parts = []
        for c in collections:
            own = points.filter(F.col("collection") == c)
            if (path := self._vectors(c)) is not None:
                live = self._table("lengths").filter(F.col("collection") == c).select("chunk_id", "stamp").join(own.select("chunk_id"), "chunk_id", "left_semi")
                parts.append(near(c, path, live.select(_stamped_id().alias("id"))))
                fresh = live.join(self.spark.read.schema("stamp string").parquet(f"{path}/stamps"), "stamp", "left_anti")
                if not fresh.limit(1).count():
                    continue
                own = own.join(fresh, "chunk_id", "left_semi")
            parts.append(scored(c, own))
        return functools.reduce(DataFrame.unionByName, parts)

    def search(self, query: str, collections: list[str] | None = None, top_k: int = TOP_K, expand_graph: bool = True, rerank=False, where: dict | None = None, exact: bool = True) -> DataFrame:
        """Packed hits: hybrid search in all collections at once, fusion over them, rerank, graph context, JSON. Unknown collections and empty queries have no hits.

        rerank: True for the stand-in, or a function (query, texts) that gives a score for each text; if it fails the hits keep their order.
        exact: whether all points of the collections are scored, or the lists near the query that index_vectors() wrote.
        """
        top_k = clamp(top_k, 1, 100)
        depth = top_k * 4 if rerank is not False else top_k
        wanted = [c for c in (collections or DEFAULT_COLLECTIONS) if c in COLLECTIONS]
        points, terms = store.read_points(self.spark, self.points, tuple(wanted)) if wanted else None, tx.query_terms(self.spark, query)
        if points is None or not terms:
            return self.spark.createDataFrame([], "chunk_id string, score double, json string")
        points = filters.matching(points, where)
        inside = F.col("collection").isin(*wanted)
        corpus = self._table("lengths").filter(inside).groupBy("collection").agg(F.count("*").alias("n"), F.sum("dl").alias("total_dl"))
        held = self.tables.get("postings", terms)
        rows = self._live_postings(held.filter(inside & F.col("term").isin(*terms))) if held is not None else self.spark.createDataFrame([], TABLES["postings"])
        sparse = retrieval.bm25_postings(rows, corpus, terms, "chunk_id", by=("collection",))
        sparse = sparse if not where else sparse.join(points.select("collection", "chunk_id"), ["collection", "chunk_id"], "left_semi")
        asked = F.array(*map(F.lit, terms)).cast("array<string>")
        vector = F.when(F.col("collection").isin(*TEXT_COLLECTIONS), self.embed_text(asked)).otherwise(self.embed(asked))
        score = lambda some, v: some.select("collection", "chunk_id", cosine(F.col("dense"), v).alias("score")).filter("score is not null")
        if exact:
            dense = score(points, vector)
        else:
            asking = self.spark.range(1).select(self.embed(asked).alias("code"), self.embed_text(asked).alias("text")).first()
            of = lambda c: list(map(float, asking["text" if c in TEXT_COLLECTIONS else "code"] or []))
            near = lambda c, path, ids: vector_index.nearest_to(self.spark, path, of(c), retrieval.over_fetch(depth), among=ids).select(F.lit(c).alias("collection"), _chunk_of("id").alias("chunk_id"), "score")
            dense = self._near(points, wanted, near, lambda c, some: score(some, vector))
        found = retrieval.hybrid_by(sparse, dense, "collection", "chunk_id", retrieval.over_fetch(depth))
        links = points.select("collection", "chunk_id", "linked_chunk_id")
        merged = fusion.merge_collections(found.join(links, ["collection", "chunk_id"], "left"), wanted).orderBy(F.col("score").desc(), "list_no", "rank", "chunk_id").limit(depth)
        payload = store.read_points(self.spark, self.points).drop("dense", "linked_chunk_id", "collection").dropDuplicates(["chunk_id"])
        hits = merged.join(payload, "chunk_id", "left").drop("list_no", "rank")
        if rerank is True:
            hits = retrieval.rerank_overlap(hits, query, "content", "chunk_id", top_k)
        elif rerank is not False:
            hits = retrieval.rerank_with(hits, rerank, query, "content", "chunk_id", top_k)
        if expand_graph:
            hits = self._expanded(hits)
        return pack.packed(hits).orderBy(*self._order(hits)).limit(top_k)

    def search_many(self, queries: DataFrame, top_k: int = TOP_K, collections: tuple[str, ...] = _CODE, exact: bool = True) -> DataFrame:
        """(query, chunk_id, file_path, score, rank) for many queries (query, text) in one job: hybrid search with the query as a key. Texts and vectors of all collections given are one corpus. exact as in search()."""
        points = store.read_points(self.spark, self.points, collections)
        queries = queries.select(F.col("query").cast("string").alias("query"), "text").distinct()
        if points is None:
            return self.spark.createDataFrame([], "query string, chunk_id string, file_path string, score double, rank int")
        depth = retrieval.over_fetch(top_k)
        lengths = self._table("lengths").filter(F.col("collection").isin(*collections))
        corpus = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_dl"))
        terms = queries.select(F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()
        held = self.tables.get("postings", terms)
        rows = self._live_postings(self.spark.createDataFrame([], TABLES["postings"]) if held is None else held).filter(F.col("collection").isin(*collections))
        sparse = retrieval.bm25_many(rows, corpus, queries, "chunk_id", depth).select("query", "chunk_id", "score")
        asked = queries.withColumn("v", self.embed(tx.tokens(F.col("text"))))
        score = lambda some: some.select("chunk_id", "dense").crossJoin(asked).select("query", "chunk_id", cosine(F.col("dense"), F.col("v")).alias("score")).filter("score is not null")  # the stated queries against all points
        if exact:
            dense = score(points)
        else:
            near = lambda c, path, ids: vector_index.nearest(self.spark, path, asked.select("query", F.col("v").alias("vector")), depth, among=ids).select("query", _chunk_of("id").alias("chunk_id"), "score")
            dense = self._near(points, [c for c in collections if c in COLLECTIONS], near, lambda c, some: score(some))
        found = retrieval.hybrid_by(sparse, dense, "query", "chunk_id", top_k)
        placed = retrieval.ranked(found, "chunk_id", ["query"])
        return placed.join(points.select("chunk_id", "file_path"), "chunk_id").select("query", "chunk_id", "file_path", "score", "rank")

    def evaluate(self, commits: DataFrame, k: int = 5, most: int = 50) -> DataFrame:
        """One row (queries, precision, mrr): how well the messages of mending commits (hash, date, message, files) find the files that these changed."""
        golden = evaluation.golden_set(commits, most)
        found = self.search_many(golden.select("query", "text"), 10 * k)
        files = found.groupBy("query", F.col("file_path").alias("item")).agg(F.min("rank").alias("first"))
        ranks = files.withColumn("rank", F.row_number().over(changes.Window.partitionBy("query").orderBy("first", "item")))
        queries = golden.select("query").distinct()
        scores = queries.join(evaluation.precision_at(ranks, golden, k), "query", "left").join(evaluation.reciprocal_rank(ranks, golden), "query", "left").na.fill(0.0)
        return scores.agg(F.count("*").alias("queries"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("rr"), 6).alias("mrr"))

    @staticmethod
    def _order(hits: DataFrame) -> list[Column]:
        return ([F.col("rerank_score").desc_nulls_last()] if "rerank_score" in hits.columns else []) + [F.col("score").desc(), F.col("chunk_id")]

    def search_response(self, query: str, **options) -> str:
        """search() as one JSON text: {"query": ..., "results": [...]}."""
        hits = self.search(query, **options)
        return pack.envelope(hits, query, self._order(hits)).first()["response"]

    def _calls(self) -> DataFrame:
        """Call edges between entities that exist: placeholders take no place under a limit."""
        real = self._table("entities").select(F.col("qualified_name").alias("node")).distinct()
        calls = self._table("edges").filter("rel_type = 'CALLS'")
        return calls.join(real, F.col("src") == F.col("node"), "left_semi").join(real, F.col("dst") == F.col("node"), "left_semi")

    def _expanded(self, hits: DataFrame) -> DataFrame:
        calls = self._calls()
        seeds = hits.filter("qualified_name is not null").select(F.col("qualified_name").alias("seed")).distinct()
        files = hits.filter("file_path is not null").select(F.col("file_path").alias("seed")).distinct()
        by_qn = hits.select("chunk_id", F.col("qualified_name").alias("of"))
        by_file = hits.select("chunk_id", F.col("file_path").alias("of"))
        name = lambda rows, ids: rows.join(ids, F.col("seed") == F.col("of")).drop("seed", "of").withColumnRenamed("chunk_id", "seed")
        touches = self._table("touches").select(F.col("file_path").alias("seed"), "hash", "date").join(files, "seed", "left_semi")
        told = self._table("commits").select("hash", "author", "message")
        commits = graph.recent_commits(touches).join(told, "hash", "left").select("seed", "hash", "date", "author", "message")
        issues = self._table("issues").select(F.col("chunk_id").alias("seed"), "issue_id", "title", "status", "source_reliability")
        return graph.graph_context(
            hits, name(graph.neighbours(seeds, calls, 1), by_qn), name(graph.neighbours(seeds, calls, 1, False), by_qn), name(graph.co_changed(self._table("pairs"), files), by_file),
            name(commits, by_file), graph.related_issues(issues))

    def recent_commits(self, file_path: str, limit: int = COMMIT_LIMIT) -> DataFrame:
        """(hash, date, author, message) of a file's latest commits."""
        seed = self._table("touches").filter(F.col("file_path") == file_path).select(F.col("file_path").alias("seed"), "hash", "date")
        found = graph.recent_commits(seed, limit).join(self._table("commits").select("hash", "author", "message"), "hash", "left")
        return found.select("hash", "date", "author", "message").orderBy(F.col("date").desc(), "hash")

    def lookup_symbol(self, name: str) -> DataFrame:
        return retrieval.lookup_symbol(self._table("entities"), name)

    def callers(self, qualified_name: str, max_hops: int = 2) -> DataFrame:
        return self._around(qualified_name, max_hops, True)

    def callees(self, qualified_name: str, max_hops: int = 2) -> DataFrame:
        return self._around(qualified_name, max_hops, False)

    def _around(self, qualified_name: str, max_hops: int, towards: bool) -> DataFrame:
        seed = self.spark.createDataFrame([(qualified_name,)], "seed string")
        found = graph.neighbours(seed, self._calls(), clamp(max_hops, 1, MAX_HOPS), towards)
        where = self._table("entities").select(F.col("qualified_name").alias("node"), "file_path", "line_start").dropDuplicates(["node"])
        return found.join(where, "node").orderBy("hops", F.col("confidence").desc(), "node")

    def co_changed(self, file_path: str, min_count: int = MIN_COUNT, limit: int = CO_CHANGE_LIMIT) -> DataFrame:
        seed = self.spark.createDataFrame([(file_path,)], "seed string")
        return graph.co_changed(self._table("pairs"), seed, max(1, min_count), clamp(limit, 1, 50))

    # ---- upkeep

    def stats(self) -> DataFrame:
        points = store.read_points(self.spark, self.points)
        return state.collection_counts(self.spark.createDataFrame([], "collection string") if points is None else points)

    def drift(self, tracked: DataFrame | None = None) -> DataFrame:
        """Files whose tracked chunk_ids are not as many as the code chunks there are."""
        tracked = self._table("file_index").filter("status = 'indexed'") if tracked is None else tracked
        points = store.read_points(self.spark, self.points, _CODE)
        actual = self.spark.createDataFrame([], "file_path string") if points is None else points.select("file_path")
        return state.drift(tracked.select("file_path", F.explode("chunk_ids").alias("id")).select("file_path"), actual, "file_path")

    @unit
    def repair(self, failed: int = 100, dirty: int = 200, fraction: float = 0.01, seed: int = 0) -> DataFrame:
        """One bounded pass: outcomes (failed_retried, dirty_processed or sample_marked_dirty, file_path, error).

        Failed files are indexed again from their sources, dirty ones if their counts differ and else
        cleared; of a sample of the indexed files those whose counts differ become dirty.
        """
        index = self._table("file_index")
        todo = self._once(state.repair_candidates(index, failed, dirty).select("file_path", "reason", "repo"))
        apart = self._once(self.drift().select("file_path"))
        again = self._once(todo.filter("reason = 'failed'").select("file_path", "repo").unionByName(todo.filter("reason = 'dirty'").join(apart, "file_path", "left_semi").select("file_path", "repo")))
        errors = self.spark.createDataFrame([], "file_path string, error string")
        for (repo,) in again.select("repo").distinct().limit(failed + dirty).collect():  # a repair pass is bounded
            told = self.index_files(self._table("sources").join(again.filter(F.col("repo").eqNullSafe(repo)), "file_path", "left_semi"), repo)
            errors = errors.unionByName(told.select("file_path", "error"))
        index = self._table("file_index")
        whole = todo.filter("reason = 'dirty'").join(again, "file_path", "left_anti").select("file_path", F.lit(False).alias("dirty"))
        sample = state.sample_files(index.filter("status = 'indexed' and not dirty").select("file_path"), fraction, 200, seed)
        marked = self._once(sample.join(self.drift().select("file_path"), "file_path", "left_semi"))
        flags = self._once(whole.unionByName(marked.withColumn("dirty", F.lit(True))))
        patched = self._once(changes.patch(index.join(flags, "file_path", "left_semi"), flags, ["file_path"]))
        self.tables.change("file_index", patched, patched, ["file_path"])
        of = lambda reason: todo.filter(F.col("reason") == reason).select("file_path").join(errors, "file_path", "left")
        return self._outcomes(("failed_retried", of("failed")), ("dirty_processed", of("dirty")), ("sample_marked_dirty", marked))

    @unit
    def recover(self) -> DataFrame:
        """Ends the operations that a lost writer left open: outcomes (recovered or failed, file_path, error).

        Their source files are indexed again from the sources table, which leaves the same rows however far the
        writer came. What is not there is marked as failed, to be scanned or sent again.
        """
        ended = self._once(state.open_intents(self._table("intents")).select("operation_id", "kind", "file_path"))
        files = ended.select("file_path").distinct()
        held = self._once(self._table("sources").join(files, "file_path", "left_semi"))
        repos = self._table("file_index").select("file_path", "repo")
        again = self._once(held.join(repos, "file_path", "left").select("file_path", "content", F.coalesce("repo", F.lit("repo")).alias("repo")))
        for (repo,) in again.select("repo").distinct().collect():  # repositories, not files
            self.index_files(again.filter(F.col("repo") == repo), repo)
        lost = self._once(files.join(held, "file_path", "left_anti").withColumn("error", F.lit("interrupted")))
        now = F.current_timestamp().alias("at")
        closed = ended.join(lost, "file_path", "left").select("operation_id", now, F.when(F.col("error").isNull(), "done").otherwise("failed").alias("state"), "kind", "file_path", "error")
        self._append("intents", self._once(closed), "file_path", lambda log: log)
        return self._outcomes(("recovered", held.select("file_path")), ("failed", lost))

    def health(self) -> dict[str, str]:
        """Whether each table can be read."""
        out = {"chunks": "ok" if store.read_points(self.spark, self.points) is not None else "missing"}
        for name in ("entities", "edges"):
            out[name] = "ok" if name in self.tables else "missing"
        return out | {"status": "ok" if all(v == "ok" for v in out.values()) else "degraded"}

    def similar(self, vector: list[float], k: int = TOP_K) -> DataFrame:
        q = F.array(*map(F.lit, vector)).cast("array<float>")
        return store.read_points(self.spark, self.points).withColumn("score", cosine(F.col("dense"), q)).orderBy(F.col("score").desc_nulls_last(), "chunk_id").limit(k)
