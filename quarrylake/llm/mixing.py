"""Mixing sources to target weights with a low-discrepancy schedule.

The points i * golden ratio mod 1 pick a source through the cumulative target
weights; the r-th slot of a source takes block r (modulo its blocks) of the
source's documents, which are shuffled by a seeded hash and cut into blocks of
equal words. Window functions run inside (source, hash bucket) and (source,
chunk of slots), so a source with a third of all rows is spread out.

Defined results: a null text has no words; a null source is a source of its
own, last in order; a document without words is taken 0 times; repeated rows
are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.llm.common import ordered_index, small_enough, stored

SPACES = r"[\x20\x09-\x0D]+"
#: Words in a block. Smaller: closer to the targets; larger: fewer slots.
BLOCK = 32
#: A source, and so a document, is taken so often at most.
REPEATS = 3
CELLS = 4096
CHUNK = 1 << 14
#: 2**31 divided by the golden ratio, made odd: multiples of it modulo 2**31 are the points.
GOLDEN, MODULUS = 1327217885, 1 << 31
SMALL = 50_000


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")).cast("long")


def _joinable(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small_enough(df, SMALL) else df


def source_targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(sid, source, source_size, target) for sizes(source, size): weights 1, 2, 3, 1, ... in source order, filled up to the caps."""
    s = ordered_index(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "sid")
    s = stored(s.withColumn("w", (F.col("sid") % 3 + 1).cast("double")).withColumn("cap", (F.col("source_size") * repeats).cast("double")))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while total:
        # what is at its cap keeps it; the rest is shared by weight
        capped = F.col("w") * level >= F.col("cap")
        n, held, w = s.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("w")))).first()
        if n == full or not w:
            break
        full, level = n, (total - held) / w
    return s.select("sid", "source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def slots(spark, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, sid, r): the schedule; slot i takes the r-th block of source sid."""
    order = W.partitionBy("half").orderBy("sid").rowsBetween(W.unboundedPreceding, W.currentRow)
    # running sums over sources in groups of 1024, then over the groups
    t = targets.select("sid", "target", F.floor(F.col("sid") / 1024).alias("half"))
    groups = t.groupBy("half").agg(F.sum("target").alias("g"))
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    n = int(-(-total // block))
    g = groups.collect() if small_enough(groups, SMALL) else groups.orderBy("half").toLocalIterator()
    before, at = [], 0.0
    for row in sorted(g, key=lambda r: r["half"]):
        before.append((row["half"], at))
        at += row["g"]
    offsets = spark.createDataFrame(before, "half long, before double")
    bounds = t.join(F.broadcast(offsets), "half").withColumn("hi", (F.sum("target").over(order) + F.col("before")) / (total or 1.0))
    bounds = bounds.select("sid", (F.col("hi") - F.col("target") / (total or 1.0)).alias("lo"), "hi")
    cells = bounds.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS - 1e-6), F.floor(F.col("hi") * CELLS + 1e-6))).alias("cell"))
    cells = stored(cells)
    points = spark.range(n).select(F.col("id").alias("i"), ((F.col("id") % MODULUS * GOLDEN + MODULUS // 2) % MODULUS / float(MODULUS)).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * CELLS))
    # bounds that float sums leave apart are closed: a point goes to the least source that reaches beyond it
    picked = points.join(_joinable(cells), "cell").where((F.col("lo") - 1e-9 <= F.col("x")) & (F.col("x") < F.col("hi") + 1e-9))
    picked = stored(picked.groupBy("i").agg(F.min("sid").alias("sid")).withColumn("chunk", F.floor(F.col("i") / CHUNK)))
    counts = picked.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    run = W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("sid", "chunk").orderBy("i")) - 1
    return picked.join(counts, ["sid", "chunk"]).select("i", "sid", (F.col("before") + inside).alias("r"))


def blocks(docs: DataFrame, seed: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, row, sid, block, words): the words that a document has in each block of its source; docs: (doc_id, row, sid, size)."""
    n = docs.agg(F.count("*")).first()[0]
    buckets = 16 + n // 20_000
    h = docs.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)))
    sums = h.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    run = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    inside = W.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    placed = h.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["sid", "bucket"])
    placed = placed.where("size > 0").select("doc_id", "row", "sid", "size", (F.col("before") + F.col("inside")).alias("a"))
    first, last = F.floor(F.col("a") / block), F.floor((F.col("a") + F.col("size") - 1) / block)
    pieces = placed.select("*", F.explode(F.sequence(first, last)).alias("block"))
    words = F.least(F.col("a") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("a"), F.col("block") * block)
    return pieces.select("doc_id", "row", "sid", "block", words.alias("words"))


def mix(docs: DataFrame, seed: int = 42, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken): what the mix takes of each document; docs: (doc_id, text, source)."""
    spark = docs.sparkSession
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("row", F.monotonically_increasing_id()))
    targets = stored(source_targets(sizes, repeats))
    near = _joinable(targets)
    rows = stored(sizes.join(near, sizes["source"].eqNullSafe(near["source"])).select("doc_id", "row", "sid", "size", "source_size", "target"))
    count = F.ceil(F.col("source_size") / block)
    plan = slots(spark, targets, block).join(_joinable(targets.where("source_size > 0").select("sid", count.alias("count"))), "sid")
    # the points of a source may exceed its target by a few; beyond the cap they take nothing
    times = plan.where(F.col("r") < F.col("count") * repeats).groupBy("sid", (F.col("r") % F.col("count")).alias("block")).agg(F.count("*").alias("times"))
    taken = blocks(rows, seed, block).join(times, ["sid", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
