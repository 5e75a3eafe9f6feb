"""Problem 2: check each new batch against everything accepted, without reprocessing the history.

Method: multi-key sorted-neighbourhood runs. A text has several sort keys, each
of four min-hash slots, and its digest as one more. The history keeps the keys
as runs, sorted and cut into key ranges of bounded size; a batch is sorted the
same way, opens only the ranges that its keys fall in, and compares only the
windows of entries around its own. Sketches and compressed texts lie apart, in
buckets of bounded size, of which only those with candidates are opened. Each
batch adds a run; runs are compacted when there are many. A manifest names the
runs that count, so a batch that fails leaves the history as it was.
"""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, cuts_held, drop_path, release, scratch, stored_rows
from .kernel import U
from .neardup import bounded
from .sketch import MASKS, SLOTS, plausible, sketches, verified, window_pairs

# Runs that may lie side by side before they are merged.
MOST_RUNS = 4
# Entries of a key range and records of a bucket, at most on average, up to 2^MOST_BITS ranges and buckets a run.
RANGE_ROWS, BUCKET_ROWS, MOST_BITS = 1 << 18, 1 << 13, 12
# A sort key: its number in the 6 highest bits, then four slots of SLOT_BITS bits. The last number is that of digests.
SLOT_BITS, DIGEST = 14, 63

# Entries of a window that are simply paired with the new records, and those of a part of a larger window, on average.
SMALL_WINDOW, WINDOW_PART = 64, 512

KEYS = "k long, low long, key long"
RECORDS = "key long, bits binary, packed binary"


def sort_keys(heads: DataFrame, rounds: int) -> DataFrame:
    """(k, low, key): the sort keys of each row of (key, digest, slots), and its digest as a key, whose other half is low (else null).

    Neighbours in sorted order agree on the key's number and their leading slots."""
    if rounds * len(MASKS) > DIGEST:
        raise ValueError("too many keys for the 6 bits of their number")

    def run(batches):
        for b in batches:
            n = len(b)
            if not n:
                continue
            rows = (np.frombuffer(b"".join(b.column("slots").to_pylist()), np.uint32).reshape(n, -1)[:, : rounds * SLOTS] & ((1 << SLOT_BITS) - 1)).astype(U)
            keys = []
            for r in range(rounds):
                for mask in MASKS:
                    k = np.full(n, U(len(keys)))
                    for s in mask:
                        k = (k << U(SLOT_BITS)) | rows[:, r * SLOTS + s]
                    keys.append(k << U(64 - 6 - 4 * SLOT_BITS))
            digest = np.frombuffer(b"".join(b.column("digest").to_pylist()), U).reshape(n, 2)
            keys.append((U(DIGEST) << U(58)) | (digest[:, 0] >> U(6)))
            count = len(keys)
            low = pa.concat_arrays([pa.nulls((count - 1) * n, pa.int64()), pa.array(digest[:, 1].view(np.int64))])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), low, pa.concat_arrays([b.column("key")] * count)], names=["k", "low", "key"])

    return heads.select("key", "digest", "slots").mapInArrow(run, KEYS)


def part_of(run: dict, at: str):
    """Number of the key range, or of the bucket, of a run's row: at is 'k' or 'key'."""
    if at == "k":
        return F.shiftrightunsigned("k", 64 - run["bits"]).cast("int") if run["bits"] else F.lit(0)
    return F.pmod(F.xxhash64("key"), F.lit(1 << run["bits"])).cast("int")


class History:
    """Accepted records: sorted key runs, and sketches and compressed texts by record."""

    def __init__(self, spark: SparkSession, path: str | None = None, threshold: float = 0.8, pieces: str = "words", width: int = 5, rounds: int = 6):
        self.spark, self.path = spark, path or scratch(spark, "history")
        self.threshold, self.pieces, self.width, self.rounds = threshold, pieces, width, rounds
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(f"{self.path}/manifest"))
        self.opened = 0  # bytes of the history's files that the last batch had to open

    # -- manifest -------------------------------------------------------------------------------------------------

    def _manifests(self) -> list[str]:
        return sorted(s.getPath().toString() for s in self._fs.listStatus(self._Path(f"{self.path}/manifest")) if s.getPath().getName().endswith(".json"))

    def runs(self) -> dict:
        """The runs that count: of keys and of records, each with path, bits, rows and parts; the batches taken in; and the
        paths that the last compaction replaced."""
        done = self._manifests()
        if not done:
            return {"keys": [], "records": [], "batches": [], "replaced": []}
        read = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(self._Path(done[-1])), "UTF-8")
        return json.loads(read)

    def _commit(self, runs: dict) -> None:
        """A manifest appears whole, under its name, or not at all."""
        name = f"{self.path}/manifest/{len(self._manifests()):09d}"
        temporary = f"{name}.{uuid.uuid4().hex}.new"
        out = self._fs.create(self._Path(temporary), False)
        out.write(bytearray(json.dumps(runs).encode()))
        out.close()
        if self._fs.exists(self._Path(f"{name}.json")) or not self._fs.rename(self._Path(temporary), self._Path(f"{name}.json")):
            raise RuntimeError("another batch was committed meanwhile: take this one again")

    # -- runs -------------------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, at: str, rows: int) -> dict:
        """Write a run: rows of one range (at 'k') or bucket (at 'key') in one folder; keys are sorted."""
        most = RANGE_ROWS if at == "k" else BUCKET_ROWS
        run = {"path": f"{self.path}/{'keys' if at == 'k' else 'records'}/{uuid.uuid4().hex}", "bits": min(MOST_BITS, max(0, math.ceil(math.log2(max(1, rows) / most)))), "rows": rows}
        own = df.withColumn("part", part_of(run, at))
        if at == "k":
            own = own.repartitionByRange("part", "k").sortWithinPartitions("part", "k")
        elif run["bits"]:
            own = own.repartition("part")
        own.write.partitionBy("part").option("compression", "zstd").parquet(run["path"])
        folders = [s.getPath() for s in self._fs.listStatus(self._Path(run["path"])) if s.getPath().getName().startswith("part=")]
        run["parts"] = {p.getName().removeprefix("part="): self._fs.getContentSummary(p).getLength() for p in folders}
        return run

    def _read(self, runs: list[dict], schema: str, parts: set[int] | None = None, at: str = "k") -> DataFrame:
        """The runs' rows; parts: only the ranges or buckets that these numbers of the finest division fall in."""
        paths = []
        for run in runs:
            wanted = None if parts is None else {str(p >> (MOST_BITS - run["bits"]) if at == "k" else p % (1 << run["bits"])) for p in parts}
            names = [n for n in run["parts"] if wanted is None or n in wanted]
            paths += [f"{run['path']}/part={n}" for n in names]
            self.opened += sum(run["parts"][n] for n in names)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _own(self, run: dict, schema: str) -> DataFrame:
        """The rows of the batch's own run, which isn't history yet."""
        opened, rows = self.opened, self._read([run], schema)
        self.opened = opened
        return rows

    def _touched(self, df: DataFrame, at: str, runs: list[dict]) -> set[int] | None:
        """Numbers of the finest division that df's keys fall in: at most 2^MOST_BITS come to the driver. None if no run is divided."""
        if not any(r["bits"] for r in runs):
            return None
        return {r[0] for r in df.select(part_of({"bits": MOST_BITS}, at)).distinct().collect()}

    # -- batches ----------------------------------------------------------------------------------------------------

    def take(self, batch: DataFrame, key: str, text: str, name: str | None = None, compare: bool = True) -> DataFrame | None:
        """Add a batch; returns (key) of its records linked to any accepted record or to one of the batch with a smaller key.

        Linked means a Jaccard similarity of at least threshold between the texts' piece sets. All records of the batch
        are accepted, linked or not. Keys are unique longs, over all batches. Null and empty texts and texts
        without a piece are never linked and leave no trace. A name makes a retry of a committed batch a no-op (None).
        compare=False only loads (the first filling of a history)."""
        runs, held = self.runs(), cuts_held()
        if name is not None and name in runs["batches"]:
            return None
        self.opened = 0
        # One pass over the batch's texts.
        mine = cut(sketches(batch, key, text, self.pieces, self.width, self.rounds * SLOTS, pack=True))
        records = self._write(mine.select("key", "bits", "packed"), "key", stored_rows(mine))
        if records["bits"]:
            self._collect()  # its shuffle holds all texts once more
        heads = mine.groupBy("digest").agg(F.min_by(F.struct("key", "slots"), "key").alias("h")).select("digest", "h.*")
        fresh = entries = cut(sort_keys(heads, self.rounds))
        if compare:
            # A text known to the history is linked, and needs no second entry among the keys.
            digests = cut(entries.filter("low is not null"))
            old = self._read(runs["keys"], KEYS, self._touched(digests, "k", runs["keys"])).filter("low is not null").select("k", F.col("low").alias("other"))
            # Compared by their difference: as a second join key they would make the broadcast table thirty times as large.
            seen = cut(old.join(bounded(digests), "k").filter(F.col("low").bitwiseXOR(F.col("other")) == 0).select("key").distinct())
            fresh = entries.join(bounded(seen), "key", "left_anti")
        per_text = self.rounds * len(MASKS) + 1
        keys = self._write(fresh, "k", stored_rows(entries) - (stored_rows(seen) * per_text if compare else 0))
        linked = cut(self._linked(mine.select("key"), runs, keys, records)) if compare else None
        release(self.spark, since=held, keep=int(compare))  # all but the result
        grown = runs | {"keys": [*runs["keys"], keys], "records": [*runs["records"], records], "batches": [*runs["batches"], *([name] if name is not None else [])]}
        self._commit(grown)
        if len(grown["keys"]) > MOST_RUNS:
            self.compact()
        self._collect()
        return linked

    def _collect(self) -> None:
        """What was broadcast or shuffled is dropped once the driver's garbage is collected; a process that takes batches for days sees to it."""
        self.spark.sparkContext._jvm.System.gc()

    def _linked(self, mine: DataFrame, runs: dict, keys: dict, records: dict) -> DataFrame:
        """(key) of the batch's linked records: all but the first of each new text that no window links.

        The history's keys are read once, for the entries of all windows, and its sketches once, for those of these entries."""
        new = cut(self._own(keys, KEYS).filter("low is null").select("k", F.col("key").alias("b")))
        old = self._read(runs["keys"], KEYS, self._touched(new, "k", runs["keys"])).filter("low is null").select("k", F.col("key").alias("a"))
        near = cut(old.join(bounded(new.select("k"), new), "k", "left_semi"))
        wanted = cut(near.select(F.col("a").alias("key")).distinct())
        known = self._read(runs["records"], RECORDS, self._touched(wanted, "key", runs["records"]), "key").select("key", "bits").join(bounded(wanted), "key", "left_semi")
        known = cut(known.unionByName(self._own(records, RECORDS).select("key", "bits")))
        by_key = bounded(new)
        counted = near.select("k", F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(new.select("k", F.lit(0).alias("old"), F.lit(1).alias("new")))
        sizes = counted.groupBy("k").agg(F.sum("old").alias("n"), F.sum("new").alias("m"))
        if (sizes.agg(F.sum(F.expr("m * n + m * (m - 1) div 2"))).first()[0] or 0) <= SMALL_WINDOW * stored_rows(new) / (self.rounds * len(MASKS)):
            # Windows that are small for the batch as a whole are simply paired, in one round.
            own = new.select("k", F.col("b").alias("a")).join(by_key, "k").filter("a < b")
            pairs = cut(near.join(by_key, "k").select("a", "b").unionByName(own.select("a", "b")).distinct())
            linked = cut(self._confirmed(pairs, known, runs, records).select(F.col("b").alias("key")).distinct())
            alone = cut(new.select(F.col("b").alias("key")).distinct().join(bounded(linked), "key", "left_anti"))
            return mine.join(bounded(alone), "key", "left_anti")
        # Else first the edges of each window, found before anything is paired: a hot key costs two pairs a record.
        ends = near.groupBy("k").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).select("k", F.explode(F.array("lo", "hi")).alias("a"))
        own_ends = new.groupBy("k").agg(F.min("b").alias("a"))
        edges = cut(ends.join(by_key, "k").select("a", "b").unionByName(own_ends.join(by_key, "k").filter("a < b").select("a", "b")).distinct())
        first = cut(self._confirmed(edges, known, runs, records).select("b").distinct())
        # Then, of the records not linked yet, the whole windows.
        left = cut(new.join(bounded(first), "b", "left_anti"))
        if not stored_rows(left):
            return mine
        rest = cut(self._whole(left, near, new, known).join(edges.hint("merge"), ["a", "b"], "left_anti"))
        linked = first if not stored_rows(rest) else first.unionByName(self._confirmed(rest, known, runs, records).select("b")).distinct()
        alone = cut(left.select(F.col("b").alias("key")).distinct().join(linked.withColumnRenamed("b", "key").hint("merge"), "key", "left_anti"))
        return mine.join(bounded(alone), "key", "left_anti")

    def _whole(self, left: DataFrame, near: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
        """(a, b): every entry a in the windows of the records b of left (k, b); near has the history's entries of the batch's windows.

        A window of more than SMALL_WINDOW entries is dealt to parts; each part meets the new records in one group, which
        only gives the pairs that the sketches leave possible. So a hot window is never one task, nor written out as pairs."""
        asked = bounded(left.select("k"), left)
        near = near.select("k", "a", F.lit(True).alias("old")).unionByName(new.select("k", F.col("b").alias("a"), F.lit(False).alias("old"))).join(asked, "k", "left_semi")
        hot = cut(near.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL_WINDOW).select("k", F.ceil(F.col("n") / WINDOW_PART).cast("int").alias("parts")))
        few = near.join(bounded(hot.select("k"), hot), "k", "left_anti").join(bounded(left), "k").filter("old or a < b").select("a", "b")
        if not stored_rows(hot):
            return few.distinct()
        members = near.join(bounded(hot), "k")
        sides = members.select("k", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.col("a").alias("key"), F.when(F.col("old"), 0).otherwise(1).alias("side"))
        asking = left.join(bounded(hot), "k").select("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("b").alias("key"), F.lit(2).alias("side"))
        met = sides.unionByName(asking).join(known.hint("merge"), "key")
        return few.unionByName(window_pairs(met, self.threshold)).distinct()

    def _confirmed(self, pairs: DataFrame, known: DataFrame, runs: dict, records: dict) -> DataFrame:
        """(a, b, similarity) of the pairs at or above the threshold: by sketch, then exactly. Opens the buckets with likely texts."""
        # Sketches first: texts only travel for the pairs that are left.
        both = pairs.select("a", "b").join(known.select(F.col("key").alias("a"), F.col("bits").alias("bits_a")), "a")
        both = both.join(known.select(F.col("key").alias("b"), F.col("bits").alias("bits_b")), "b")
        likely = cut(plausible(both, self.threshold))
        wanted = likely.select(F.col("a").alias("key"))
        mine = self._own(records, RECORDS).select("key", "packed")
        old = self._read(runs["records"], RECORDS, self._touched(wanted, "key", runs["records"]), "key").select("key", "packed")
        left = old.unionByName(mine).join(bounded(wanted, likely), "key", "left_semi")
        texts = likely.join(left.select(F.col("key").alias("a"), F.col("packed").alias("packed_a")), "a")
        texts = texts.join(mine.select(F.col("key").alias("b"), F.col("packed").alias("packed_b")), "b")
        return verified(texts, self.pieces, self.width, self.threshold)

    def compact(self) -> None:
        """Merge runs, of keys and of records. The first run, which holds nearly all, is only rewritten once those behind it hold a
        quarter of its rows: each row is written a logarithmic number of times. Replaced files stay until the next compaction,
        so a reader of the old manifest can finish."""
        runs = self.runs()
        grown, replaced = dict(runs), []
        for kind, at, schema in (("keys", "k", KEYS), ("records", "key", RECORDS)):
            own = runs[kind]
            first = 0 if own and sum(r["rows"] for r in own[1:]) >= own[0]["rows"] / 4 else 1
            if len(own) - first < 2:
                continue
            merged = own[first:]
            grown[kind] = [*own[:first], self._write(self._read(merged, schema), at, sum(r["rows"] for r in merged))]
            replaced += [r["path"] for r in merged]
        if not replaced:
            return
        self._commit(grown | {"replaced": replaced})
        for path in runs["replaced"]:
            drop_path(self.spark, path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def batch_duplicates(accepted: DataFrame, incoming: DataFrame, key: str, text: str, batch: str, threshold: float, pieces: str, width: int) -> DataFrame:
    """(key, batch) of the incoming records that bring nothing new, batch after batch, in order of the batch number.

    Records without a batch number come last. The history is filled with the accepted records first."""
    spark = incoming.sparkSession
    history = History(spark, None, threshold, pieces, width)
    history.take(accepted, key, text, "accepted", compare=False)
    last = (1 << 31) - 1
    numbered = incoming.withColumn(batch, F.coalesce(F.col(batch), F.lit(last)))
    out = None
    # One loop a batch, as the batches arrive; their numbers alone come to the driver.
    for r in numbered.select(batch).distinct().orderBy(batch).toLocalIterator():
        found = history.take(numbered.filter(F.col(batch) == r[0]), key, text, f"batch {r[0]}")
        found = found.select(F.col("key").alias(key), F.lit(r[0]).alias(batch))
        out = found if out is None else out.unionByName(found)
    history.drop()
    return out if out is not None else incoming.select(key, batch).limit(0)
