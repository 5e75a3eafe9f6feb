"""Retrieval: BM25, vector search, fusion, boosts, filters, multi-query union, parent recall."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename
from ..plugins import PairScorer, Tokenizer, tokenize
from ..session import cut
from ..rules import BM25_B, BM25_EPSILON, BM25_K1, TOP_K, WEIGHT_BM25, WEIGHT_VECTOR


def corpus_stats(df: DataFrame, text: str, tokenizer: Tokenizer = tokenize) -> tuple[DataFrame, DataFrame]:
    """(terms (term, df), corpus (n, avgdl, mean_idf)): document frequencies are combined before their shuffle."""
    docs = df.filter(F.col(text).isNotNull()).select(tokenizer(F.col(text)).alias("t"))
    # One pass: each text adds its distinct terms, and itself under a mark that is no term.
    mark = F.lit("\x00")
    counted = docs.select(F.size("t").alias("dl"), F.explode(F.concat(F.array_distinct("t"), F.array(mark))).alias("term"))
    counted = cut(counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("total")))
    terms = counted.filter(F.col("term") != mark).select("term", "df")
    sizes = counted.filter(F.col("term") == mark).select(F.col("df").alias("n"), (F.col("total") / F.col("df")).alias("avgdl"))
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = terms.crossJoin(F.broadcast(sizes)).agg(F.avg(idf).alias("mean_idf"))  # sizes and mean have one row
    return terms, sizes.crossJoin(mean)


def occurrences(tokens: str, word: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == F.lit(word)))


def bm25(df: DataFrame, key: str, text: str, query: list[str], tokenizer: Tokenizer = tokenize, stats: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(key, bm25) of the rows with a positive score. Repeated query tokens count each time; a negative idf becomes epsilon times
    the mean idf. Rows are scored where they are: the query's few terms are what travels."""
    return bm25_many(df, key, text, [query], tokenizer, stats).select(key, "bm25")


def bm25_many(df: DataFrame, key: str, text: str, queries: list[list[str]], tokenizer: Tokenizer = tokenize, stats: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(key, query_no, bm25): as bm25, for several queries in one pass over the texts."""
    words = sorted({w for q in queries for w in q})
    if not words:
        return df.select(key, F.lit(0).alias("query_no"), F.lit(0.0).alias("bm25")).limit(0)
    terms, corpus = stats or corpus_stats(df, text, tokenizer)
    # One row: the corpus figures and the frequencies of the queries' terms.
    asked = terms.filter(F.col("term").isin(words)).agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("dfs"))
    one = corpus.crossJoin(asked)
    docs = df.filter(F.col(text).isNotNull()).select(key, tokenizer(F.col(text)).alias("t"))
    docs = docs.select(key, F.size("t").alias("dl"), *[occurrences("t", w).alias(f"tf{k}") for k, w in enumerate(words)])
    docs = docs.filter(" or ".join(f"tf{k} > 0" for k in range(len(words)))).crossJoin(F.broadcast(one))
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl"))

    def part(word: str) -> Column:
        tf = F.col(f"tf{words.index(word)}")
        d = F.coalesce(F.element_at("dfs", F.lit(word)), F.lit(0))
        weight = F.log(F.col("n") - d + 0.5) - F.log(d + 0.5)
        weight = F.when(weight < 0, BM25_EPSILON * F.col("mean_idf")).otherwise(weight)
        return F.when(tf > 0, weight * tf * (BM25_K1 + 1) / (tf + norm)).otherwise(0.0)

    scores = [sum((n * part(w) for w, n in sorted(Counter(q).items())), F.lit(0.0)) for q in queries]
    each = F.array(*[F.struct(F.lit(k).alias("query_no"), s.alias("bm25")) for k, s in enumerate(scores)])
    return docs.select(key, F.explode(each).alias("s")).select(key, "s.query_no", "s.bm25").filter("bm25 > 0")


def postings(df: DataFrame, key: str, text: str, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """(term, key, tf, dl): the inverted index of the rows with text; dl is a row's number of tokens."""
    docs = df.filter(F.col(text).isNotNull()).select(key, tokenizer(F.col(text)).alias("t"))
    return docs.select(key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf")).select("term", key, "tf", "dl")


def index_stats(index: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(terms (term, df), corpus (n, avgdl, mean_idf)) of an inverted index; rows without any token count nowhere."""
    terms = index.groupBy("term").agg(F.count("*").alias("df"))
    sizes = index.select(key, "dl").distinct().agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = terms.crossJoin(F.broadcast(sizes)).agg(F.avg(idf).alias("mean_idf"))  # sizes and mean have one row
    return terms, sizes.crossJoin(mean)


def bm25_of(index: DataFrame, key: str, query: list[str], stats: tuple[DataFrame, DataFrame]) -> DataFrame:
    """bm25 from an inverted index: only the postings of the query's terms are read (a filter that reaches the sorted files)."""
    repeats = Counter(query)
    if not repeats:
        return index.select(key, F.lit(0.0).alias("bm25")).limit(0)
    terms, corpus = stats
    words = sorted(repeats)
    times = F.create_map(*[F.lit(x) for w in words for x in (w, repeats[w])])
    asked = F.broadcast(terms.filter(F.col("term").isin(words)))  # a row a query term
    hit = index.filter(F.col("term").isin(words)).join(asked, "term").crossJoin(F.broadcast(corpus))  # one row
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weight = F.when(raw < 0, BM25_EPSILON * F.col("mean_idf")).otherwise(raw)
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl"))
    part = times[F.col("term")] * weight * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + norm)
    return hit.groupBy(key).agg(F.sum(part).alias("bm25")).filter("bm25 > 0")


def reranked(df: DataFrame, text: str, question: str, scorer: PairScorer) -> DataFrame:
    """df with the column rerank: the pair scorer's score of question and text. For the few rows of a result: batches run
    where the rows are, and the order is the caller's."""

    def run(batches):
        for b in batches:
            yield b.append_column("rerank", pa.array(np.asarray(scorer(question, b.column(text).to_pylist()), float), pa.float64()))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "rerank double"])
    return df.mapInArrow(run, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_topk(df: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """(key, similarity, rank) of the k nearest rows by cosine of unit vectors; ties go to the smaller key. Filters on df come first.

    A top-k keeps k rows a partition, so any number of rows is ranked without a full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = df.filter(F.col(vector).isNotNull()).select(key, F.round(dot(F.col(vector), q), 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), key)))  # k rows


def topk(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(k)


def fused(vectors: DataFrame, lexical: DataFrame, content: str, weight_vector: float = WEIGHT_VECTOR, weight_bm25: float = WEIGHT_BM25) -> DataFrame:
    """(content, score, v_rank, b_rank): weighted sum of reciprocal vector rank and BM25 score, each over its list's maximum.

    vectors: (content, rank); lexical: (content, bm25, b_rank). A content that stands several times in a list takes its last
    score, once for each time. An empty list adds nothing. Both lists are top-k lists."""
    v = vectors.groupBy(content).agg(F.count("*").alias("occ"), F.max("rank").alias("last"), F.min("rank").alias("v_rank")).withColumn("s", 1.0 / F.col("last"))
    b = lexical.groupBy(content).agg(F.count("*").alias("occ"), F.max_by("bm25", "b_rank").alias("s"), F.min("b_rank").alias("b_rank"))
    # Over the k rows of a list; joining its maximum would compute the list a second time.
    top = F.max("s").over(Window.partitionBy())
    scaled = lambda d, w, rank: d.withColumn("m", top).select(content, F.when(F.col("m") > 0, F.col("occ") * w * F.col("s") / F.col("m")).otherwise(0.0).alias("part"), rank)
    vs = scaled(v, weight_vector, F.col("v_rank")).withColumn("b_rank", F.lit(None).cast("int"))
    bs = scaled(b, weight_bm25, F.col("b_rank")).withColumn("v_rank", F.lit(None).cast("int"))
    return vs.unionByName(bs).groupBy(content).agg(F.sum("part").alias("score"), F.min("v_rank").alias("v_rank"), F.min("b_rank").alias("b_rank"))



def fused_order() -> list[Column]:
    """Score first; ties in order of the vector list, then of the BM25 list."""
    return [F.desc(F.round("score", 9)), F.asc_nulls_last("v_rank"), F.asc_nulls_last("b_rank")]


def hybrid(
    df: DataFrame, key: str, text: str, vector: str, query_text: list[str], query_vector: list[float], top_k: int = TOP_K, conditions: dict | None = None, stats=None, index: DataFrame | None = None, cut_to_k: bool = True
) -> DataFrame:
    """(key, score): vector list under the filter and unfiltered BM25 list, fused on the key, filtered again, cut to top_k.

    index: an inverted index of df with its stats, else df is scored where it is. cut_to_k=False leaves all fused rows."""
    k = max(4 * top_k, 20)
    v = vector_topk(matching(df, conditions), key, vector, query_vector, k).select(key, "rank")
    scored = bm25_of(index, key, query_text, stats) if index is not None else bm25(df, key, text, query_text, stats=stats)
    b = topk(scored, "bm25", key, k).withColumn("b_rank", F.row_number().over(Window.orderBy(F.desc("bm25"), key)))
    out = fused(v, b, key)
    kept = out.join(matching(df, conditions).select(key), key, "left_semi") if conditions else out
    return kept.orderBy(*fused_order(), key).limit(top_k) if cut_to_k else kept


def matching(df: DataFrame, conditions: dict | None) -> DataFrame:
    """Rows in which every named column equals its value; a null never does."""
    for c, v in (conditions or {}).items():
        df = df.filter(F.col(c) == F.lit(v))
    return df


def with_tag(df: DataFrame, tags: str, name: str) -> DataFrame:
    """Rows one of whose tags contains the name."""
    return df.filter(F.exists(tags, lambda t: F.contains(t, F.lit(name))))


def tag_level(tags: Column, name: str) -> Column:
    """2 where a tag is the name, 1 where one starts with it, 0 where one contains it, else null."""
    level = F.transform(tags, lambda t: F.when(t == name, 2).when(t.startswith(name), 1).when(F.contains(t, F.lit(name)), 0))
    return F.array_max(level)


def name_first(df: DataFrame, tags: str, source: str, score: str, name: str) -> list[Column]:
    """Order: rows with the name in a tag first, by level and file name; the rest by score."""
    level = tag_level(F.col(tags), name)
    return [F.when(level.isNotNull(), 0).otherwise(1), F.desc_nulls_last(level), F.when(level.isNotNull(), basename(F.col(source))), F.desc_nulls_last(score)]


def version_first(versions: list[str], order: str) -> list[Column]:
    return [F.when(F.col("version").isin(*versions), 0).otherwise(1), F.col(order)]


def first_seen(results: DataFrame, query_no: str, rank: str, content: str) -> DataFrame:
    """Union of several queries' results: of each content the row of the first query, then the best rank."""
    w = Window.partitionBy(F.xxhash64(content), content).orderBy(query_no, rank)
    return results.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def supplemented(found: DataFrame, more: DataFrame, content: str, prefix: int = 100) -> DataFrame:
    """found, then the rows of more whose first `prefix` characters no found row has."""
    seen = found.select(F.substring(content, 1, prefix).alias("__p")).distinct()
    return found.unionByName(more.withColumn("__p", F.substring(content, 1, prefix)).join(seen, "__p", "left_anti").drop("__p"))


def version_supplement(rows: DataFrame, found: DataFrame, wanted: list[str], text: str, key: str, question: str, scorer: PairScorer, most: int) -> DataFrame:
    """Up to `most` rows of the wanted versions whose first 100 characters no found row has, best by the pair scorer."""
    seen = found.select(F.substring(text, 1, 100).alias("__p")).distinct()
    more = rows.filter(F.col("version").isin(*wanted)).withColumn("__p", F.substring(text, 1, 100)).join(seen, "__p", "left_anti").drop("__p")
    return reranked(more, text, question, scorer).orderBy(F.desc("rerank"), key).limit(most)


def parents(hits: DataFrame, rows: DataFrame, parent: str, rank: str) -> DataFrame:
    """Parent rows of child hits, each once, by the best rank of its children."""
    best = hits.groupBy(parent).agg(F.min(rank).alias("best_rank"))
    return rows.join(best, parent)


def idf(n: int, df: int) -> float:
    return math.log(n - df + 0.5) - math.log(df + 0.5)


def conversation(df: DataFrame, conv: str, turn: str, role: str, content: str, most: int | None = None) -> DataFrame:
    """(conv, history): a line a message in order of turn; every role but 'user' is labelled assistant, null contents are left out.

    Of repeated turns with equal content one is kept. most: only the last so many turns."""
    said = F.when(F.lower(F.trim(role)) == "user", "user").otherwise("assistant")
    own = df.filter(F.col(content).isNotNull()).select(F.col(conv).alias("__conv"), F.col(turn).alias("__turn"), said.alias("__role"), F.col(content).alias("__text")).distinct()
    if most:
        own = own.withColumn("__n", F.row_number().over(Window.partitionBy("__conv").orderBy(F.desc("__turn"), "__role", "__text"))).filter(F.col("__n") <= most)
    rows = F.array_sort(F.collect_list(F.struct("__turn", "__role", "__text")))
    lines = F.transform(rows, lambda x: F.concat(x["__role"], F.lit(": "), x["__text"]))
    return own.groupBy("__conv").agg(F.array_join(lines, "\n").alias("history")).withColumnRenamed("__conv", conv)


def context(df: DataFrame, rank: str, content: str, rows: int = 5, chars: int = 1000) -> DataFrame:
    """One row: the first characters of the best rows, numbered, as a prompt's context block."""
    best = df.orderBy(rank).limit(rows)
    parts = F.array_sort(F.collect_list(F.struct(rank, F.substring(content, 1, chars).alias("c"))))
    return best.agg(F.array_join(F.transform(parts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["c"])), "\n\n").alias("context"))
