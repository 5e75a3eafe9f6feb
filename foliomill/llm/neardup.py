"""Problem 1: near-duplicate records with small edits.

Method: covering locality-sensitive hashing. A record's set of pieces becomes
rows of min-hash slots; structured bit masks over each row guarantee that two
rows which differ in at most RADIUS slots collide in some table. Candidates are
weighed by a one-bit sketch, verified exactly, and linked records become groups
by a star contraction whose rounds are checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, stored_rows
from .sketch import SLOTS, compared, covering_keys, packed_texts, plausible, sketches, verified

# Buckets up to this many texts give all their pairs at once; larger ones are compared part by part (large_pairs).
SMALL_BUCKET = 24
# Texts of a large bucket's part, on average.
DIVIDED_BUCKET = 512
# Edges of a vertex, and copies of a text, from which they are not sent to one task; members of a part of a large class.
HUB, CLASS_PART = 20_000, 1000
# Most bytes of a table that is broadcast, as rows in memory; beyond it the join is shuffled.
BROADCAST_BYTES = 8 << 20


def bounded(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Mark df for broadcast if its rows, measured with their texts and arrays, are small; else ask for a shuffled join.

    df is read for that, so it should be a table that is already written. of: a table by cut that has at least df's rows; the
    rows of such a table are known without a job, which is all that columns of fixed width need."""
    size = F.lit(32 + 8 * len(df.columns)).cast("long")
    known = of if of is not None else df if hasattr(df, "cut_path") else None
    fixed = not any(isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)) for f in df.schema.fields)
    if known is not None and fixed and stored_rows(known) * (32 + 8 * len(df.columns)) <= BROADCAST_BYTES:
        return F.broadcast(df)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + 16 * F.coalesce(F.size(F.col(f.name)), F.lit(0))
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df.hint("merge")


def fetched(pairs: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (a, b) with the compressed texts of both; only texts that a pair needs leave the scan."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    own = texts.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    packed = cut(packed_texts(own.join(bounded(wanted), "key", "left_semi"), "key", "text"))
    left = packed.select(F.col("key").alias("a"), F.col("packed").alias("packed_a"))
    right = packed.select(F.col("key").alias("b"), F.col("packed").alias("packed_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b")


def expanded(keys: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, large): all pairs (a < b) of the buckets of up to `most` rows (bucket, key), and the rows of the larger ones.

    Buckets are counted before anything is gathered: one of two texts is its least and greatest key, and only the rows of
    larger ones are read again. A bucket is gathered into one row only if it has at most `most`."""
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).filter("n > 1")
    sizes = cut(sizes)
    two = sizes.filter("n = 2 and a < b").select("a", "b")
    several = cut(keys.join(bounded(sizes.filter("n > 2").select("bucket", "n")), "bucket"))
    held = several.filter(F.col("n") <= most).groupBy("bucket").agg(F.array_sort(F.collect_set("key")).alias("ks"))
    pairs = F.flatten(F.transform("ks", lambda x, i: F.transform(F.filter("ks", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    small = two.unionByName(held.select(F.explode(pairs).alias("p")).select("p.a", "p.b"))
    return cut(small.distinct()), several.filter(F.col("n") > most).select("bucket", "key")


def bucket_pairs(heads: DataFrame, rounds: int, threshold: float) -> DataFrame:
    """Candidate pairs (a < b) of heads (key, slots, bits): all pairs of small buckets, and those of large ones that the
    sketch does not rule out."""
    pairs, large = expanded(covering_keys(heads, rounds), SMALL_BUCKET)
    return pairs if large.limit(1).isEmpty() else pairs.unionByName(large_pairs(large, heads, rounds, threshold)).distinct()


def large_pairs(large: DataFrame, heads: DataFrame, rounds: int, threshold: float) -> DataFrame:
    """Pairs (a < b) of the large buckets (bucket, key) that the sketch does not rule out.

    A bucket's texts are dealt to parts by a hash, and any two parts meet in one group, so all pairs are compared and no
    task holds more than two parts. Which buckets two texts share is told by their slots: a pair comes out once."""
    parts = cut(large.groupBy("bucket").agg(F.ceil(F.count("*") / DIVIDED_BUCKET).cast("int").alias("parts")))
    own = large.join(bounded(parts), "bucket").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    met = own.join(heads.select("key", "slots", "bits"), "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return cut(compared(met.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}), rounds, threshold))


def split_join(edges: DataFrame, about: DataFrame) -> DataFrame:
    """edges (u, v) with m of about (u, m, n: the edges of u), the edges of hubs by a broadcast of the hubs alone."""
    about = cut(about)
    # A vertex has no more edges than there are.
    if stored_rows(edges) <= HUB or (hubs := about.filter(F.col("n") > HUB).select("u", "m")).isEmpty():
        return edges.join(about.select("u", "m"), "u")
    few = bounded(cut(hubs))
    rest = edges.join(few.select("u"), "u", "left_anti").join(about.filter(F.col("n") <= HUB).select("u", "m"), "u")
    return edges.join(few, "u").unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """(key, root) of the vertices of links (a, b): root is the least key of the component.

    Alternating large and small stars; each pair of rounds is checkpointed and pre-aggregates before its shuffle, and
    no vertex gathers its neighbours into one row. The edges of a hub, a vertex with more than HUB of them, stay where they
    are: what they need to know of it is broadcast, or, past the bound of bounded, joined under adaptive skew handling."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    mark = None
    while True:
        both = cut(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = split_join(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = split_join(large, low).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        edges = cut(small)
        # A fixed point is a set of stars. Equal counts and sums of hashes stand for equal edges.
        new = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            return edges.groupBy(F.col("u").alias("key")).agg(F.min("v").alias("root")).unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())
        mark = new


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.8, pieces: str = "words", width: int = 5, rounds: int = 6) -> tuple[DataFrame, DataFrame]:
    """Groups of near-duplicate records: (members, links).

    members (key, class_id, links) has one row for each record that has a linked other: class_id is the least key of its
    group, links the number of its links to different texts. links (a, b, similarity) holds the verified links between
    representatives of exact copies. Two records are linked if their sets of pieces have a Jaccard similarity of
    at least threshold; a group is all that is linked directly or through others. Keys are longs and unique.

    Null and empty texts, and texts without a whole piece, belong to no group. Records of equal letters and digits (exact
    copies) are collapsed first, so a group of copies of any size costs one row a copy. An empty table gives no rows.
    rounds: covering codes; a pair at similarity s is found with chance 1 - (1 - P)^rounds, P the chance that at most
    2 of 7 slots differ (0.42 at 0.6, 0.65 at 0.7, 0.85 at 0.8)."""
    sk = cut(sketches(df, key, text, pieces, width, rounds * SLOTS))
    heads = sk.groupBy("digest").agg(F.min_by(F.struct("key", "slots", "bits"), "key").alias("h"), F.count("*").alias("copies"))
    heads = cut(heads.select("digest", "copies", "h.*"))

    pairs = bucket_pairs(heads, rounds, threshold)
    bits = heads.select("key", "bits")
    weighed = pairs.join(bits.withColumnsRenamed({"key": "a", "bits": "bits_a"}), "a").join(bits.withColumnsRenamed({"key": "b", "bits": "bits_b"}), "b")
    candidates = cut(plausible(weighed, threshold))
    links = cut(verified(fetched(candidates, df, key, text), pieces, width, threshold))
    roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").count()
    classes = cut(
        heads.select("digest", "key", "copies")
        .join(roots, "key", "left")
        .join(degree, "key", "left")
        .select("digest", F.coalesce("root", "key").alias("class_id"), F.coalesce("count", F.lit(0)).alias("links"), "copies", F.col("root").isNotNull().alias("linked"))
        .filter("linked or copies > 1")
    )
    # A text that many records share must not gather them in one task: what is known of such texts goes to the records.
    rows = sk.select("key", "digest")
    often = bounded(cut(classes.filter(F.col("copies") > HUB)))
    rest = rows.join(often.select("digest"), "digest", "left_anti").join(classes.filter(F.col("copies") <= HUB), "digest")
    members = rows.join(often, "digest").unionByName(rest).select("key", "class_id", "links")
    return members, links


def group_pairs(members: DataFrame) -> DataFrame:
    """(record_id_a, record_id_b): all pairs of one group, as p1_found is stated; smaller id first."""
    # The second side of a large class is dealt to parts, and the first goes to each of them: no task pairs a whole class.
    parts = cut(members.groupBy("class_id").agg(F.ceil(F.count("*") / CLASS_PART).cast("int").alias("parts")).filter("parts > 1"))
    own = members.select("class_id", "key").join(bounded(parts), "class_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = own.select("class_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("key").alias("record_id_a"))
    b = own.select("class_id", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.col("key").alias("record_id_b"))
    return a.join(b, ["class_id", "part"]).filter("record_id_a < record_id_b").select("record_id_a", "record_id_b")
