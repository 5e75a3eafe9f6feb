"""Facade: build a knowledge base from documents, keep it up to date, and query it."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import normalise
from .operators import chunk, clean, labels, manifest, search, structure, versions
from .plugins import ChatClient, EchoChat, Embedder, HashedEmbedder, PairScorer, VisionClient, overlap_scorer, rewritten, tokenize
from .rules import TOP_K
from .session import cut, cuts_held, release, ship
from .sources.files import load_documents, scan

RELEVANCE = "struct<scenario_type:string,rules:array<string>,entities:array<string>,test_points:array<string>>"
SCHEMAS = {
    "chunks": "chunk_id string, source string, file_hash string, version string, type string, part int, section_index int, section_level int, section_title string, tags array<string>, module string, "
    f"test_relevance {RELEVANCE}, chunk_index int, chunk string, chunk_type string, original_length int, embedding array<float>",
    "files": "path string, hash string, processed_at timestamp, size long, modified_at timestamp, image_processed boolean",
    "postings": "term string, chunk_id string, tf long, dl int, source string",
}
# Changed files of a build that are named to the reader one by one; more of them are told by a join.
NAMED_FILES = 10_000


class KnowledgeBase:
    """Chunks, vectors, inverted index and manifest below a folder.

    What a build or a deletion changes counts from its commit on, one small file that appears whole: a run that dies before
    leaves nothing that a reader or the next run would see."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, chat: ChatClient | None = None, scorer: PairScorer | None = overlap_scorer, vision: VisionClient | None = None, chat_tags: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        self.embedder, self.chat, self.scorer, self.vision, self.chat_tags = embedder or HashedEmbedder(), chat or EchoChat(), scorer, vision, chat_tags
        self._stats: tuple[int, tuple[DataFrame, DataFrame]] | None = None
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(f"{self.path}/commits"))
        ship(spark)

    # -- storage ----------------------------------------------------------------------------------------------------

    def commits(self) -> list[dict]:
        """What counts, oldest first: folders of data, and sources deleted since; a rebuild starts anew."""
        found = sorted(s.getPath().toString() for s in self._fs.listStatus(self._Path(f"{self.path}/commits")) if s.getPath().getName().endswith(".json"))
        read = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        every = [json.loads(read.toString(self._fs.open(self._Path(p)), "UTF-8")) for p in found]
        last = max((k for k, e in enumerate(every) if e["anew"]), default=0)
        return every[last:]

    def _commit(self, data: str | None, deleted: list[str], anew: bool = False) -> None:
        number = len(self._fs.listStatus(self._Path(f"{self.path}/commits")))
        name = f"{self.path}/commits/{number:012d}"
        out = self._fs.create(self._Path(f"{name}.new"), True)
        out.write(bytearray(json.dumps({"data": data, "deleted": deleted, "anew": anew}).encode()))
        out.close()
        if not self._fs.rename(self._Path(f"{name}.new"), self._Path(f"{name}.json")):
            raise RuntimeError("another run committed meanwhile")

    def _table(self, name: str, source: str = "source") -> DataFrame:
        """A table over all commits that count, without the rows of sources deleted later."""
        out, gone = None, []
        for e in reversed(self.commits()):
            if e["data"]:
                part = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/data/{e['data']}/{name}")
                part = part.filter(~F.coalesce(F.col(source).isin(*gone), F.lit(False))) if gone else part
                out = part if out is None else out.unionByName(part)
            gone = gone + e["deleted"]
        return out if out is not None else self.spark.createDataFrame([], SCHEMAS[name])

    def chunks(self) -> DataFrame:
        return self._table("chunks")

    def state(self) -> DataFrame:
        return self._table("files", "path")

    def index(self) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
        """The inverted index, and its statistics, computed once for each state of the store."""
        postings = self._table("postings")
        number = len(self._fs.listStatus(self._Path(f"{self.path}/commits")))
        if self._stats is None or self._stats[0] != number:
            terms, corpus = search.index_stats(postings, "chunk_id")
            self._stats = (number, (cut(terms), cut(corpus)))
        return postings, self._stats[1]

    # -- build ------------------------------------------------------------------------------------------------------

    def embedded(self, chunks: DataFrame) -> DataFrame:
        own = self.embedder

        def run(batches):
            for b in batches:
                v = own([t or "" for t in b.column("chunk").to_pylist()])
                yield b.append_column("embedding", pa.array(list(v), pa.list_(pa.float32())))

        return chunks.mapInArrow(run, _with(chunks, "embedding array<float>"))

    def split(self, docs: DataFrame) -> DataFrame:
        """Documents as sections or paragraphs by their structure, short ones joined to the one before within a document:
        (doc, section_index, section_level, section_title, text)."""
        rows = docs.withColumn("strategy", structure.strategy(F.col("page_content"), F.col("source")))
        parts = None
        for name, heading in (("markdown", structure.markdown_heading), ("word", structure.word_heading)):
            own = structure.sections(rows.filter(F.col("strategy") == name), "doc", "page_content", heading).withColumnRenamed("section", "text")
            parts = own if parts is None else parts.unionByName(own)
        plain = structure.paragraphs(rows.filter("strategy = 'paragraph'"), "doc", "page_content")
        plain = plain.select("doc", F.col("paragraph_index").alias("section_index"), F.lit(0).alias("section_level"), F.lit("").alias("section_title"), F.col("paragraph").alias("text"))
        every = parts.unionByName(plain).withColumn("section_index", F.col("section_index").cast("long"))
        joined = structure.merge_short(every, "section_index", "text", ["section_level", "section_title"], part="doc")
        return joined.withColumn("section_index", F.col("first_section_index").cast("int")).drop("first_section_index")

    def prepare(self, docs: DataFrame) -> DataFrame:
        """Chunks of documents: split by structure, cleaned, deduplicated, normalised, tagged, cut and embedded."""
        docs = docs.filter("page_content is not null").withColumn("doc", F.sha2(F.concat_ws("\x01", "source", "version", F.col("part").cast("string")), 256))
        rows = self.split(docs).withColumn("text", clean.cleaned(F.col("text")))
        rows = cut(rows.withColumn("row", F.concat_ws("-", "doc", F.lpad(F.col("section_index").cast("string"), 9, "0"))))
        rows = clean.long_enough(clean.deduplicated(rows, "row", "text"), "text").withColumn("text", normalise(F.col("text")))
        rows = rows.join(docs.select("doc", "source", "file_hash", "version", "type", "part"), "doc")
        rows = labels.chat_tags(rows, "text", "section_title", "section_index", self.chat) if self.chat_tags else rows.withColumn("chat_tags", F.array().cast("array<string>"))
        own = labels.tags(F.col("source"), F.col("version"), F.col("section_title"), F.col("text"), F.col("section_level"))
        rows = cut(rows.withColumns({"tags": F.array_sort(F.array_union(own, "chat_tags")), "module": labels.module_name(F.col("source")), "test_relevance": labels.scenario(F.col("text"))}).drop("chat_tags"))
        chunks = chunk.semantic_chunks(rows, "row", "text").join(rows.drop("text", "doc"), "row")
        return self.embedded(chunks.withColumn("chunk_id", F.concat_ws("-", "row", F.col("chunk_index").cast("string"))).drop("row"))

    def _take(self, docs: DataFrame, files: DataFrame, anew: bool) -> None:
        """Write the data of documents and files, then commit them together."""
        name = uuid.uuid4().hex
        into = f"{self.path}/data/{name}"
        self.prepare(docs).write.parquet(f"{into}/chunks")
        written = self.spark.read.schema(SCHEMAS["chunks"]).parquet(f"{into}/chunks")
        postings = search.postings(written.select("chunk_id", "chunk"), "chunk_id", "chunk").join(written.select("chunk_id", "source"), "chunk_id")
        # Sorted by term: the few terms of a question touch few row groups.
        postings.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{into}/postings")
        files.write.parquet(f"{into}/files")
        self._commit(name, [], anew)

    def build(self, folder: str, version: str | None = None, rebuild: bool = False) -> int:
        """Take in the new and changed files of a folder. Returns the files taken in.

        The listing is compared with the manifest first: a file of known size and time isn't opened. Of the others the hash
        decides. Files that fail to parse are not marked as processed."""
        held = cuts_held()
        listing = scan(self.spark, folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
        state = self.state()
        known = manifest.latest(state).select("path", "hash")
        same = state.select(manifest.plain_path(F.col("path")).alias("plain"), "size", "modified_at").distinct()
        stale = listing.withColumn("plain", manifest.plain_path(F.col("path")))
        stale = cut((stale if rebuild else stale.join(same, ["plain", "size", "modified_at"], "left_anti")).select("path"))
        paths = [r.path for r in stale.limit(NAMED_FILES + 1).collect()]
        if not paths:
            if rebuild:
                self._commit(None, [], True)
            return 0
        many = len(paths) > NAMED_FILES
        docs = cut(load_documents(self.spark, folder if many else paths, version, stale if many else None, self.vision))
        files = docs.groupBy(F.col("source").alias("path")).agg(F.max("file_hash").alias("hash"), F.max("size").alias("size"), F.max("modified_at").alias("modified_at"), F.max("error").alias("error"))
        files = cut(files.filter("error is null").drop("error"))
        due = cut(files if rebuild else manifest.changed(files, known_state(known)))
        n = due.count()
        # A file that was only touched is noted with its new time, so that it isn't opened again.
        noted = files.select("path", "hash", F.current_timestamp().alias("processed_at"), "size", "modified_at", F.lit(self.vision is not None).alias("image_processed"))
        if files.limit(1).isEmpty() and not rebuild:
            return 0
        self._take(docs.join(due.select(F.col("path").alias("source")), "source", "left_semi"), noted, rebuild)
        release(self.spark, since=held)
        return n

    def add_documents(self, docs: DataFrame) -> None:
        """Take in documents that are no files: (source, file_hash, version, type, part, page_content)."""
        files = docs.groupBy(F.col("source").alias("path")).agg(F.max("file_hash").alias("hash"))
        none = lambda kind: F.lit(None).cast(kind)
        self._take(docs, files.select("path", "hash", F.current_timestamp().alias("processed_at"), none("long").alias("size"), none("timestamp").alias("modified_at"), F.lit(False).alias("image_processed")), False)

    def delete(self, source: str) -> None:
        """Remove a file's chunks, postings and manifest row, by a commit: readers of the state before go on undisturbed."""
        self._commit(None, [source])

    # -- query ------------------------------------------------------------------------------------------------------

    def _terms(self, question: str) -> list[str]:
        return self.spark.range(1).select(tokenize(F.lit(question))).first()[0]

    def _vector(self, question: str) -> list[float]:
        return [float(x) for x in self.embedder([question])[0]]

    def _reranked(self, rows: DataFrame, question: str) -> DataFrame:
        return search.reranked(rows, "chunk", question, self.scorer) if self.scorer is not None else rows.withColumn("rerank", F.lit(0.0))

    def _held(self, rows: DataFrame) -> DataFrame:
        """The few rows of a top-k as a table of the driver's: computed once, and no file is left behind for a question."""
        return self.spark.createDataFrame(rows.toArrow(), rows.schema)

    def retrieve(self, question: str, version: str | None = None, top_k: int = TOP_K, conditions: dict | None = None, strict: bool = False) -> DataFrame:
        """Best chunks for a question: BM25 and vector ranks fused under a version expression and equality conditions, then
        reranked. A document's name instead of a version puts that document's chunks first, all of them being candidates."""
        rows, (postings, stats) = self.chunks(), self.index()
        name = version if version and versions._is_name(version.strip()) else None
        conditions = dict(conditions or {})
        if version and not name:
            hit = versions.resolve(rows, version)
            if not hit and strict:
                return rows.withColumns({"score": F.lit(0.0), "rerank": F.lit(0.0)}).limit(0)
            conditions |= {"version": hit[0]} if hit else {}
        best = search.hybrid(rows, "chunk_id", "chunk", "embedding", self._terms(question), self._vector(question), top_k, conditions, stats, postings, cut_to_k=False)
        found = self._held(rows.join(F.broadcast(best), "chunk_id"))  # two lists of at most max(4 * top_k, 20) rows
        if not name:
            return self._reranked(found, question).orderBy(F.desc("rerank"), *search.fused_order(), "chunk_id").limit(top_k).drop("v_rank", "b_rank")
        more = search.matching(search.with_tag(rows, "tags", name), conditions).withColumns({"score": F.lit(None).cast("double"), "v_rank": F.lit(None).cast("int"), "b_rank": F.lit(None).cast("int")})
        every = search.supplemented(found, more.select(found.columns), "chunk")
        return every.orderBy(*search.name_first(every, "tags", "source", "score", name), "chunk_id").limit(top_k).withColumn("rerank", F.lit(0.0)).drop("v_rank", "b_rank")

    def multi_retrieve(self, question: str, rewrites: list[str] | None = None, top_k: int = TOP_K, boost_versions: list[str] | None = None, boost_name: str | None = None, **options) -> DataFrame:
        """The question and up to two rewritings (the chat client's unless given): first-seen union of their results; chunks of
        the versions to boost first, with more of these versions; then reranked, and a named document's chunks first."""
        asked = [question, *rewrites[:2]] if rewrites is not None else rewritten(self.chat, question)
        parts = None
        for no, q in enumerate(asked):
            got = self.retrieve(q, top_k=top_k, **options).withColumn("query_no", F.lit(no))
            parts = got if parts is None else parts.unionByName(got)
        ranked = parts.withColumn("rank", -F.col("score"))
        found = self._held(search.first_seen(ranked, "query_no", "rank", "chunk").drop("rerank"))  # three lists of top_k
        if boost_versions:
            extra = search.version_supplement(self.chunks(), found, boost_versions, "chunk", "chunk_id", question, self.scorer or overlap_scorer, top_k).drop("rerank")
            none = {"score": F.lit(None).cast("double"), "query_no": F.lit(len(asked)), "rank": F.lit(None).cast("double")}
            found = found.unionByName(extra.withColumns(none))
        scored = self._reranked(found, question)
        order = [F.when(search.tag_level(F.col("tags"), boost_name).isNotNull(), 0).otherwise(1)] if boost_name else []
        boosted = [F.when(F.col("version").isin(*boost_versions), 0).otherwise(1)] if boost_versions else []
        return scored.orderBy(*order, F.desc("rerank"), *boosted, "query_no", F.asc_nulls_last("rank"), "chunk_id").limit(top_k).drop("rank")

    def filtered_retrieve(self, question: str, conditions: dict, top_k: int = TOP_K) -> DataFrame:
        """Vector search alone, under equality conditions that are applied before the top-k, then reranked."""
        rows = search.matching(self.chunks(), conditions)
        best = search.vector_topk(rows, "chunk_id", "embedding", self._vector(question), 2 * top_k)
        return self._reranked(rows.join(F.broadcast(best), "chunk_id"), question).orderBy(F.desc("rerank"), "rank").limit(top_k)

    def parent_retrieve(self, question: str, top_k: int = TOP_K, **options) -> DataFrame:
        """Whole files of the best chunks: their chunks joined in order, each file once, by its best chunk."""
        hits = self._held(self.retrieve(question, top_k=2 * top_k, **options).select("source", (-F.col("score")).alias("rank")))
        found = search.parents(hits, self.chunks().join(F.broadcast(hits.select("source").distinct()), "source", "left_semi"), "source", "rank")
        texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("version", "part", "section_index", "chunk_index", "chunk"))), lambda x: x["chunk"]), "\n\n")
        return found.groupBy("source").agg(texts.alias("text"), F.min("best_rank").alias("best_rank")).orderBy("best_rank", "source").limit(top_k)

    def advanced_retrieve(self, question: str, history: list[dict] | None = None, parent: bool = False, rewrites: list[str] | None = None, conditions: dict | None = None, top_k: int = TOP_K) -> DataFrame:
        """A question in the light of a conversation, then parents, several queries, a filtered or a plain search."""
        if history:
            said = "\n".join(f"{'user' if m['role'] == 'user' else 'assistant'}: {m['content']}" for m in history)
            question = self.chat.chat([{"role": "user", "content": f"{said}\n{question}"}]) or question
        if parent:
            return self.parent_retrieve(question, top_k, conditions=conditions)
        if rewrites:
            return self.multi_retrieve(question, rewrites, top_k, conditions=conditions)
        return self.filtered_retrieve(question, conditions, top_k) if conditions else self.retrieve(question, top_k=top_k)

    def requested_retrieve(self, question: str, wanted: str | None = None, top_k: int = TOP_K) -> DataFrame:
        """Several queries under a comma-separated request of versions and a document's name, which are boosted, not filtered."""
        named, name = versions.requested(self.chunks(), wanted) if wanted else ([], None)
        return self.multi_retrieve(question, None, top_k, named or None, name)

    @staticmethod
    def preview(rows: DataFrame, chars: int = 200) -> DataFrame:
        """(source, version, preview): the first characters of retrieved chunks."""
        return rows.select("source", "version", F.substring("chunk", 1, chars).alias("preview"))

    def context(self, question: str, **options) -> str:
        got = self.retrieve(question, **options).withColumn("no", -F.col("score"))
        return search.context(got, "no", "chunk").first()[0]

    def ask(self, question: str, **options) -> str:
        """The chat client's answer over the retrieved context."""
        return self.chat.chat([{"role": "user", "content": f"{self.context(question, **options)}\n\n{question}"}])


def known_state(known: DataFrame) -> DataFrame:
    """A manifest of (path, hash) in the form that manifest.changed reads."""
    none = lambda kind: F.lit(None).cast(kind)
    return known.select("path", "hash", none("timestamp").alias("processed_at"), none("long").alias("size"), F.lit(True).alias("image_processed"))


def _with(df: DataFrame, extra: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), extra])
