"""Problem 9: mix sources to target shares of tokens.

Method: entropy balancing. Each record gets the rate exp(l * tokens / mean) of
its source, clipped at the source's cap; l solves the convex dual of the token
constraint. All sources' Newton steps are one distributed aggregation an
iteration, over token counts kept from one pass through the texts. A source
whose goal is its cap needs no iteration: all its records get the cap. Rates
are rounded into copies systematically; of PHASES starting points of the
rounding a source takes the one whose total comes nearest to its goal.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .kernel import passes
from .neardup import bounded

# Records that one window of the rounding holds, about.
ROUNDING_BLOCK = 5000
PHASES = 16
UNCAPPED = float("inf")

# Tilt of a source whose records all get the cap.
FULL = 1e12

_ENCODERS: dict = {}


def encoder(path: str, pattern: str):
    import tiktoken

    if path not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_count(enc, text: str) -> int:
    """Tokens of a text. The tokenizer's own matcher panics at blank runs of about a million characters; its splitter in Python,
    which gives the same pieces, counts such a text."""
    try:
        return len(enc.encode_ordinary(text))
    except BaseException as panic:  # a panic isn't an Exception
        if type(panic).__name__ != "PanicException":
            raise
    return len(enc._encode_only_native_bpe(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")))


def token_counts(df: DataFrame, key: str, text: str, source: str, ranks_path: str, pattern: str) -> DataFrame:
    """(key, source, tokens): tokens of each text that isn't null, by a byte-level BPE given as a file of ranks."""

    def run(batches):
        enc = encoder(ranks_path, pattern)
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in passes(texts):
                n = [token_count(enc, t) for t in texts[lo:hi]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(n, pa.int64())], names=["key", "source", "tokens"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("source", T.StringType()), T.StructField("tokens", T.LongType())])
    return df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")).filter("text is not null and source is not null").mapInArrow(run, schema)


def token_goals(sizes: dict[str, float], targets: dict[str, tuple[float, float]], total: float | None) -> dict[str, float]:
    """Tokens each source shall give: its share of the total, at most its cap; what capped sources leave over goes to the
    others in proportion to their shares, so these keep their ratios. Sources without tokens or target give none."""
    live = {s: w for s, (w, _) in targets.items() if sizes.get(s) and w > 0}
    total = total or sum(sizes[s] for s in live)
    most = {s: targets[s][1] * sizes[s] for s in live}
    goals: dict[str, float] = {}
    while live:
        left = total - sum(goals.values())
        scale = left / sum(live.values())
        full = [s for s, w in live.items() if w * scale >= most[s]]
        if not full:
            return goals | {s: w * scale for s, w in live.items()}
        for s in full:
            goals[s] = most[s]
            live.pop(s)
    return goals


def balanced_rates(counts: DataFrame, goals: DataFrame, tolerance: float = 1e-6, rounds: int = 60) -> tuple[DataFrame, int]:
    """(source, l, mean, cap, n) solving sum(min(cap, exp(l * tokens / mean)) * tokens) = goal for every source, and the iterations used.

    goals: (source, goal, cap, mean, n). Newton steps on the logarithm of the sum, which is nearly a line in l where the longest
    texts make up the sum. It grows with l, so the solution is bracketed from the first sum on; a step that leaves the bracket, or
    isn't half as long as the one before the last, is replaced by the bracket's middle: no source creeps towards its goal. Only one
    row a source is kept; counts are aggregated before the shuffle."""
    # A goal at the cap is met by the cap alone: the solution lies at infinity.
    full = F.col("goal") >= F.col("cap") * F.col("mean") * F.col("n") * (1 - 1e-9)
    none = F.lit(None).cast("double")
    state = goals.withColumns({"l": F.when(full, FULL).otherwise(0.0), "low": none, "high": none, "moved": F.lit(UNCAPPED), "before": F.lit(UNCAPPED), "done": full})
    x = F.col("tokens") / F.col("mean")
    for k in range(rounds):
        state = cut(state)
        if state.filter("not done").isEmpty():
            return state, k
        tilt = F.exp(F.least(F.col("l") * x, F.lit(50.0)))
        rate = F.least("cap", tilt)
        sums = (
            counts.join(bounded(state.filter("not done").select("source", "l", "mean", "cap")), "source")
            .groupBy("source")
            .agg(
                F.sum(rate * F.col("tokens")).alias("got"),
                F.sum(F.when(tilt <= F.col("cap"), rate * x * F.col("tokens")).otherwise(0.0)).alias("slope"),
                F.min(x).alias("least"),
                F.max(x).alias("most"),
            )
        )
        at = state.join(sums, "source", "left")
        at = at.withColumns({"low": F.when(F.col("got") < F.col("goal"), F.col("l")).otherwise(F.col("low")), "high": F.when(F.col("got") > F.col("goal"), F.col("l")).otherwise(F.col("high"))})
        # No source lies beyond these, with a margin for rounding: above, its longest text alone would exceed the goal, or all texts
        # would be at the cap; below, even the rate of the shortest text wouldn't do for all.
        longest = F.col("most") * F.col("mean")
        above = F.when(F.col("cap") * longest > F.col("goal"), F.log(F.col("goal") / longest) / F.col("most")).otherwise(F.log("cap") / F.col("least"))
        below = F.log(F.col("goal") / (F.col("mean") * F.col("n"))) / F.col("least")
        at = at.withColumns({"low": F.coalesce("low", below * (1 + 1e-6)), "high": F.coalesce("high", above * (1 + 1e-6))})
        step = F.log(F.col("goal") / F.col("got")) * F.col("got") / F.greatest("slope", F.lit(1e-300))
        newton = F.col("l") + step
        inside = (newton > F.col("low")) & (newton < F.col("high")) & (2 * F.abs(step) <= F.col("before"))
        new = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        done = F.col("done") | (F.abs(F.col("got") - F.col("goal")) <= tolerance * F.col("goal")) | F.coalesce(F.col("high") - F.col("low") <= 1e-15 * F.abs("l"), F.lit(False))
        state = at.select("source", "goal", "cap", "mean", "n", F.when(done, F.col("l")).otherwise(new).alias("l"), "low", "high", F.abs(new - F.col("l")).alias("moved"), F.col("moved").alias("before"), done.alias("done"))
    return cut(state), rounds


def rounded(counts: DataFrame, rates: DataFrame) -> DataFrame:
    """(key, source, tokens, copies): systematic rounding of the rates within blocks of each source, in order of tokens."""
    own = counts.join(bounded(rates.select("source", "goal", "l", "mean", "cap", "n")), "source")
    rate = F.least("cap", F.exp(F.least(F.col("l") * F.col("tokens") / F.col("mean"), F.lit(50.0))))
    block = F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), F.ceil(F.col("n") / ROUNDING_BLOCK)))
    own = own.withColumns({"rate": rate, "block": block})
    w = Window.partitionBy("source", "block").orderBy("tokens", "key")
    # The phase of a block is drawn from its name; a whole cap stays exact.
    phase = F.pmod(F.xxhash64("source", "block"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    placed = cut(own.select("key", "source", "goal", "tokens", "rate", "cap", (F.sum("rate").over(w) + phase).alias("upto")))

    def copies(k) -> Column:
        at = F.col("upto") + k / F.lit(float(PHASES)) + 1e-9
        return F.least(F.floor(at) - F.floor(at - F.col("rate")), F.floor(F.col("cap") + 1e-9)).cast("long")

    totals = placed.groupBy("source", "goal").agg(*[F.sum(F.col("tokens") * copies(F.lit(k))).alias(f"t{k}") for k in range(PHASES)])
    off = lambda k: F.abs(F.col(f"t{k}") - F.col("goal"))
    best = F.array_min(F.array(*[F.struct(off(k).alias("off"), F.lit(k).alias("k")) for k in range(PHASES)]))["k"]
    chosen = cut(totals.select("source", best.alias("k")))
    return placed.join(bounded(chosen), "source").select("key", "source", "tokens", copies(F.col("k")).alias("copies"))


def mixed(df: DataFrame, key: str, text: str, source: str, targets: DataFrame, ranks_path: str, pattern: str, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): chosen (key, source, tokens, copies) has the rows with at least one copy; shares reports by
    source documents, tokens, target_share, max_repeat, goal_share and reached_share.

    targets: (source, target_share, max_repeat), a row a source; a null max_repeat means no cap, a null or non-positive
    share no part. Of repeated targets the greatest share counts. Rows with null text or source, and sources without
    target, take no part; a target without documents is reported with share 0. total: tokens wanted; by default as many
    as the sources with a target hold. The set of sources is small (one row each on the driver): the records aren't."""
    spark = df.sparkSession
    counts = cut(token_counts(df, key, text, source, ranks_path, pattern).filter("tokens > 0"))
    sizes = counts.groupBy("source").agg(F.sum("tokens").alias("size"), F.count("*").alias("n"))
    wanted = targets.groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("w"), F.coalesce(F.col("max_repeat").cast("double"), F.lit(UNCAPPED)).alias("cap"))).alias("t")).filter("source is not null")
    rows = wanted.join(sizes, "source", "left").collect()
    goals = token_goals({r.source: float(r["size"] or 0) for r in rows}, {r.source: (r.t.w, r.t.cap) for r in rows}, total)
    plan = [(r.source, goals[r.source], r.t.cap, r["size"] / r.n, r.n) for r in rows if goals.get(r.source)]
    schema = "source string, goal double, cap double, mean double, n long"
    rates, _ = balanced_rates(counts, spark.createDataFrame(plan, schema))
    copies = cut(rounded(counts, rates))
    chosen = copies.filter("copies > 0")
    reached = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    all_goals = spark.createDataFrame([(s, g / sum(goals.values())) for s, g in goals.items()], "source string, goal_share double")
    sum_ = reached.agg(F.sum("tokens").alias("total"))
    shares = (
        wanted.select("source", F.col("t.w").alias("target_share"), F.when(F.col("t.cap") < UNCAPPED, F.col("t.cap").cast("int")).alias("max_repeat"))
        .join(all_goals, "source", "left")
        .join(reached, "source", "left")
        .crossJoin(F.broadcast(sum_))  # an aggregate without keys: one row
        .select("source", "target_share", "max_repeat", F.coalesce("goal_share", F.lit(0.0)).alias("goal_share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("reached_share"))
    )
    return chosen.withColumnRenamed("key", key), shares


def public_ranks() -> tuple[str, str]:
    """Default tokenizer: path of the multilingual byte BPE's ranks, and its split pattern."""
    import public_tokenizers

    folder = os.environ.get("FOLIOMILL_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, "byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
