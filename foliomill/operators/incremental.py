"""Process only new or changed records: disjoint intervals of processed sequence numbers, committed with the output.

A log keeps which sequence numbers have been processed as disjoint closed
intervals. A run subtracts them from what is available, processes the gaps
(late commits included) and commits output and merged intervals in one step,
so a failure neither skips nor repeats a record.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, scratch


def ranged(edges: DataFrame) -> DataFrame:
    """(at, a, p, x, pid): the edges summed by place and sorted into ranges of places; pid numbers the ranges in their order."""
    own = edges.groupBy("at").agg(F.sum("a").alias("a"), F.sum("p").alias("p"), F.max("x").alias("x"))
    return cut(own.repartitionByRange("at").withColumn("pid", F.spark_partition_id()))


def swept(edges: DataFrame) -> DataFrame:
    """(at, x, pid, now, before): whether available numbers without processed ones lie from each place on, and just before it.

    edges: (at, a, p, x), a and p being how many available and processed intervals start (ends negative) at a place, x marks
    places asked for. Each range of places is summed up by itself; what it starts from is carried over a window with one
    row a range, so no task sees all places."""
    own = ranged(edges)
    w = Window.partitionBy("pid").orderBy("at")
    ahead = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a range: at most spark.sql.shuffle.partitions
    sums = own.groupBy("pid").agg(F.sum("a").alias("sa"), F.sum("p").alias("sp"))
    carried = sums.select("pid", F.coalesce(F.sum("sa").over(ahead), F.lit(0)).alias("ca"), F.coalesce(F.sum("sp").over(ahead), F.lit(0)).alias("cp"))
    state = own.join(F.broadcast(carried), "pid").withColumns({"ra": F.sum("a").over(w) + F.col("ca"), "rp": F.sum("p").over(w) + F.col("cp")})
    open_ = lambda a, p: (a > 0) & (p == 0)
    return state.select("at", "x", "pid", open_(F.col("ra"), F.col("rp")).alias("now"), open_(F.col("ra") - F.col("a"), F.col("rp") - F.col("p")).alias("before"))


def edges(parts: DataFrame, available: bool) -> DataFrame:
    """Both ends of intervals (first, last) as edges."""
    zero = F.lit(0)
    at = lambda place, n: F.struct(place.alias("at"), (F.lit(n) if available else zero).alias("a"), (zero if available else F.lit(n)).alias("p"))
    return parts.select(F.explode(F.array(at(F.col("first"), 1), at(F.col("last") + 1, -1))).alias("e")).select("e.*", F.lit(False).alias("x"))


def closed(state: DataFrame) -> DataFrame:
    """(first, last): the maximal intervals of a swept table. Where one ends is the next change, at times in a later range."""
    flips = cut(state.filter("now != before").select("at", "pid", "now"))
    w = Window.partitionBy("pid").orderBy("at")
    later = Window.orderBy("pid").rowsBetween(1, Window.unboundedFollowing)  # a row a range
    heads = flips.groupBy("pid").agg(F.min("at").alias("head"))
    following = heads.select("pid", F.min("head").over(later).alias("then"))
    ends = flips.withColumn("next", F.lead("at").over(w)).join(F.broadcast(following), "pid")
    return ends.filter("now").select(F.col("at").alias("first"), (F.coalesce("next", "then") - 1).alias("last"))


def intervals(df: DataFrame, seq: str) -> DataFrame:
    """(first, last): the distinct numbers of seq as disjoint, maximal closed intervals; nulls are left out."""
    own = df.select(F.col(seq).cast("long").alias("first")).filter("first is not null").distinct()
    return merged(own.withColumn("last", F.col("first")))


def merged(parts: DataFrame) -> DataFrame:
    """(first, last) of overlapping or adjacent intervals merged into maximal ones."""
    return closed(swept(edges(parts, True)))


def subtract(available: DataFrame, processed: DataFrame) -> DataFrame:
    """(first, last): what of the available intervals no processed interval covers. Either may be empty."""
    return closed(swept(edges(available, True).unionByName(edges(processed, False))))


def within(df: DataFrame, seq: str, parts: DataFrame) -> DataFrame:
    """Rows of df whose seq lies in one of the intervals: the numbers alone are swept along with the intervals' ends."""
    zero = F.lit(0)
    asked = df.select(F.col(seq).cast("long").alias("at")).filter("at is not null").distinct().select("at", zero.alias("a"), zero.alias("p"), F.lit(True).alias("x"))
    inside = swept(edges(parts, True).unionByName(asked)).filter("x and now").select(F.col("at").alias(seq))
    return df.join(inside, seq, "left_semi")


def plain_path(path: Column) -> Column:
    """A path with forward slashes and without a leading './'."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def file_changes(scan: DataFrame, state: DataFrame, runs: DataFrame, log: IntervalLog | None = None) -> DataFrame:
    """(scan_id): listing rows of the files that are new or changed since a successful run processed them.

    The sequence numbers are those of the listing. What the successful runs left behind (of each path the hash of its state
    row with the greatest processed_at; a tie takes the greater hash) says which listing rows are processed: those with
    that path and hash. Their numbers are committed to an interval log; of each file's current row (the greatest version, then
    the smallest scan_id) the numbers that no interval covers are what is left to do. Unfinished runs commit nothing.
    Rows without path or hash are ignored in both tables, null versions and times are the least, unknown runs and null
    statuses aren't successful. Repeated rows and empty tables need nothing special: without state every current row is new."""
    hashed = lambda d, path, digest: d.filter(F.col(path).isNotNull() & F.col(digest).isNotNull() & (F.col(digest) != ""))
    listed = hashed(scan, "source", "file_hash").select("scan_id", plain_path(F.col("source")).alias("path"), "version", F.col("file_hash").alias("hash"))
    good = runs.filter(F.lower("status") == "success").select("run_id").distinct()
    done = hashed(state, "path", "hash").join(good, "run_id", "left_semi")
    known = done.groupBy(plain_path(F.col("path")).alias("path")).agg(F.max(F.struct("processed_at", "hash")).alias("row")).select("path", F.col("row.hash").alias("hash"))
    log = log or IntervalLog(scan.sparkSession)
    processed = listed.join(known, ["path", "hash"], "left_semi").select("scan_id")
    log.commit(processed, processed, "scan_id")
    current = listed.groupBy("path").agg(F.max(F.struct("version", (-F.col("scan_id")).alias("order"))).alias("row")).select((-F.col("row.order")).alias("scan_id"))
    return log.pending(current, "scan_id")


class IntervalLog:
    """Durable record of processed sequence numbers, kept with the output they produced.

    A commit is one small file, created only if no other commit took its number; it names the output and the
    intervals of that commit. What no commit names is invisible, so a run that dies leaves nothing behind but
    unreferenced files, and its numbers stay gaps for the next run."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch(spark, "log")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(f"{self.path}/commits"))

    def commits(self) -> list[dict]:
        """The committed entries, oldest first; one small file a run."""
        found = sorted(s.getPath().toString() for s in self._fs.listStatus(self._Path(f"{self.path}/commits")) if s.getPath().getName().endswith(".json"))
        return [json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(self._Path(p)), "UTF-8")) for p in found]

    def processed(self) -> DataFrame:
        """(first, last): merged intervals of the latest commit."""
        done = self.commits()
        return self.spark.read.parquet(done[-1]["intervals"]) if done else self.spark.createDataFrame([], "first long, last long")

    def pending(self, rows: DataFrame, seq: str) -> DataFrame:
        """Rows whose sequence number no commit covers, however late they arrived; null numbers never become due."""
        return within(rows.filter(F.col(seq).isNotNull()), seq, subtract(intervals(rows, seq), self.processed()))

    def commit(self, output: DataFrame, rows: DataFrame, seq: str) -> None:
        """Write the output of the pending rows and, in the same commit, the merged intervals."""
        number, name = len(self.commits()), uuid.uuid4().hex
        entry = {"output": f"{self.path}/data/{name}", "intervals": f"{self.path}/intervals/{name}"}
        output.write.parquet(entry["output"])
        merged(self.processed().unionByName(intervals(rows, seq))).write.parquet(entry["intervals"])
        out = self._fs.create(self._Path(f"{self.path}/commits/{number:012d}.json"), False)  # fails if another run took the number
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()

    def output(self) -> DataFrame | None:
        """All committed output."""
        done = self.commits()
        return self.spark.read.parquet(*[c["output"] for c in done]) if done else None
