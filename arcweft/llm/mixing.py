"""Mixing sources to target weights, in DataFrame operations only.

Each source's words are packed into fixed-length blocks, documents in a fixed order one after another.  The output is
shards of equal numbers of slots.  Each shard draws its sources' counts from a multinomial distribution in proportion
to the targets: every slot draws a source by a hash of its number, and the draws are counted within the shard.  A
source's slots are numbered through all shards by sums of these counts; number j takes the block at place j mod n of a
pseudorandom permutation of the source's n blocks, another one for each pass.  Slots and blocks are joined by index.

A source with share p of n slots comes out within about sqrt((1 - p) / (p n)) of its target.  Blocks are BLOCK words
long at most, and shorter where the table would have fewer than FINE slots, down to single words.

Targets: sources weigh 1, 2, 3, 1, ... in code-point order, null last, and share all words by weight; a target stops at
MOST_TIMES times its source's size, and the excess is shared by weight among the rest until none is above.

No group is ever gathered: documents are placed by sums over hashed buckets of a source, slots by sums over runs of
shards.  Sources (one row each) are numbered and filled up in one sort; they are broadcast if MOST_BROADCAST at most.

Defined cases: null and empty texts have size 0 and are never taken; an empty table gives no rows; repeated rows are
documents of their own; ties in the order of documents do not change any total; extra columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweft.llm.common import cut

BLOCK, FINE, SLOTS, MOST_TIMES, ROUNDS, SEED = 32, 1 << 18, 1024, 3, 16, 17
#: Documents of a bucket, shards of a run, least cells of the draw, sources that are broadcast, shards whose slots are written out in one task.
BUCKET, RUN, CELLS, MOST_BROADCAST, WRITTEN = 2000, 4096, 1024, 10_000, 64
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, text_column: str = "text", source_column: str = "source", id_column: str = "doc_id") -> DataFrame:
    """(row, doc_id, source, size) of every row, materialised: the text is read once."""
    size = F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long")
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), size.alias("size")))


def block_words(sizes: DataFrame) -> int:
    """Words of a block for these documents."""
    return max(1, min(BLOCK, (sizes.agg(F.sum("size")).first()[0] or 0) // FINE))


def targets(sizes: DataFrame, block: int) -> DataFrame:
    """(source, sn, source_size, target, n): a row for each source; n is its number of blocks."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sn", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("w", (F.col("sn") % 3 + 1).cast("double")).withColumn("cap", F.lit(float(MOST_TIMES)) * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "sn").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / weight)
    # In order of the level at which a source is full: those full at the common level come first.
    rows = rows.withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    rows = rows.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(common * F.col("w")))
    return rows.select("source", F.col("sn").cast("long").alias("sn"), "source_size", "target", F.ceil(F.col("source_size") / F.lit(block)).cast("long").alias("n"))


def permuted(place: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 for each key, by rounds that swap a place with its mirror or do not.

    An aggregate over the rounds: projections of their own would be merged into an expression that doubles each round.
    """

    def step(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), *key, r), n) - x, n)
        swap = F.xxhash64(F.lit(SEED + 1), *key, r, F.greatest(x, mirror)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), place, step)


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df of so many rows, broadcast if they are few."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def slots(sources: DataFrame) -> DataFrame:
    """(shard, slot, sn, idx): which block of which source fills each slot of each output shard."""
    spark = sources.sparkSession
    wanted = sources.where("n > 0").select("sn", "n", (F.col("n") * F.col("target") / F.col("source_size")).alias("d"))
    total, many = wanted.agg(F.sum("d"), F.count("*")).first()
    total = total or 0.0
    shards = max(1, round(total / SLOTS))
    each = -int(-total // shards)

    # Every slot draws a source: sources are stretches of [0, total), cut into cells to be joined by.
    cells = max(CELLS, 4 * many)
    cell = lambda x: F.floor(F.least(F.greatest(x / F.lit(total or 1.0), F.lit(0.0)), F.lit(1.0)) * cells)
    order = Window.orderBy("sn")
    ranges = wanted.withColumn("low", F.coalesce(F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ranges = cut(ranges.withColumn("high", F.coalesce(F.lead("low").over(order), F.lit(float("inf")))))
    stretches = ranges.select("sn", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    unit = F.pmod(F.xxhash64(F.lit(SEED + 2), "id"), F.lit(1 << 50)).cast("double") / F.lit(float(1 << 50))
    draws = spark.range(shards * each).select(F.floor(F.col("id") / F.lit(max(1, each))).alias("shard"), (unit * F.lit(total)).alias("u"))
    drawn = draws.withColumn("cell", cell(F.col("u"))).join(_few(stretches, many), "cell").where("u >= low and u < high")
    counts = cut(drawn.groupBy("shard", "sn").agg(F.count("*").alias("c")).withColumn("run", F.floor(F.col("shard") / RUN)))

    # A source's slots are numbered through all shards, and a shard's through its sources.
    runs = counts.groupBy("sn", "run").agg(F.sum("c").alias("k"))
    runs = runs.select("sn", "run", F.coalesce(F.sum("k").over(Window.partitionBy("sn").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("c").over(Window.partitionBy("sn", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.coalesce(F.sum("c").over(Window.partitionBy("shard").orderBy("sn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("within", within).withColumn("first", first).join(runs, ["sn", "run"]).join(_few(sources.select("sn", "n"), many), "sn")
    # A source is gone through MOST_TIMES times at most.
    begin = F.col("before") + F.col("within")
    placed = placed.withColumn("begin", begin).withColumn("end", F.least(begin + F.col("c"), F.lit(MOST_TIMES) * F.col("n"))).where("begin < end")
    # The counts are few rows; the slots that they stand for are written out in as many tasks as these call for.
    placed = placed.repartition(-(-shards // WRITTEN), "shard")
    every = placed.select("shard", "sn", "n", (F.col("first") - F.col("begin")).alias("shift"), F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("j"))
    return every.select("shard", (F.col("shift") + F.col("j")).alias("slot"), "sn", permuted(F.col("j") % F.col("n"), F.col("n"), F.col("sn"), F.floor(F.col("j") / F.col("n"))).alias("idx"))


def blocks(sizes: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """(row, sn, idx, start, words): which words of which row make up each block; start counts from 0 in the row."""
    buckets = max(1, -(-sizes.count() // BUCKET))
    named = _few(sources.select(F.col("source").alias("s"), "sn"), sources.count())
    rows = sizes.where("size > 0").join(named, F.col("source").eqNullSafe(F.col("s"))).select("row", "doc_id", "sn", "size")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "size"), F.lit(buckets)))
    parts = rows.groupBy("sn", "bucket").agg(F.sum("size").alias("c"))
    parts = parts.withColumn("offset", F.coalesce(F.sum("c").over(Window.partitionBy("sn").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    within = F.sum("size").over(Window.partitionBy("sn", "bucket").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", within).join(parts, ["sn", "bucket"]).select("row", "sn", "size", (F.col("offset") + F.col("end")).alias("end"))
    rows = rows.withColumn("begin", F.col("end") - F.col("size"))
    rows = rows.withColumn("idx", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    first, last = F.greatest("begin", F.col("idx") * block), F.least("end", (F.col("idx") + 1) * block)
    return rows.select("row", "sn", "idx", (first - F.col("begin")).alias("start"), (last - first).alias("words"))


def mix_documents(docs: DataFrame, text_column: str = "text", source_column: str = "source", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: taken is how many of its words the mix takes, repeats counted."""
    sizes = sized(docs, text_column, source_column, id_column)
    block = block_words(sizes)
    sources = cut(targets(sizes, block))
    uses = slots(sources).groupBy("sn", "idx").agg(F.count("*").alias("uses"))
    taken = blocks(sizes, sources, block).join(uses, ["sn", "idx"]).groupBy("row").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    known = sizes.join(_few(sources.select(F.col("source").alias("s"), "source_size", "target"), sources.count()), F.col("source").eqNullSafe(F.col("s")))
    return known.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_pieces(docs: DataFrame, text_column: str = "text", source_column: str = "source", id_column: str = "doc_id") -> DataFrame:
    """(shard, slot, doc_id, start, text): the mix itself; a slot's pieces in order of place are one block."""
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), F.col(text_column).alias("text")))
    sizes = cut(rows.select("row", "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    block = block_words(sizes)
    sources = cut(targets(sizes, block))
    pieces = blocks(sizes, sources, block).join(rows.select("row", "doc_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w")), "row")
    pieces = pieces.select("sn", "idx", "doc_id", "start", F.array_join(F.slice("w", (F.col("start") + 1).cast("int"), F.col("words").cast("int")), " ").alias("text"))
    return slots(sources).join(pieces, ["sn", "idx"]).select("shard", "slot", "doc_id", "start", "text")
