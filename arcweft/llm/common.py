"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweft.plans.loops import cut, ensure_checkpoint_dir

#: Bytes of text that a Python worker handles at once, about.  Spark bounds its batches by bytes (spark.sql.execution.arrow.maxBytesPerBatch).
RUN_BYTES = 2_000_000


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table of its own in the shared checkpoint folder: columns are stored and read one by one."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_columns(df: DataFrame, *own: str) -> list[str]:
    """Columns that pass on beside an operator's own, whose names theirs would clash with in any case of letters."""
    taken = {x.lower() for x in own}
    return [c for c in df.columns if c.lower() not in taken]


def free(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def tidy(run: Callable) -> Callable:
    """run, a function from batches to batches, which afterwards gives freed memory back: Python workers live on."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    """Return freed memory to the machine, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo."""
    return F.crc32(F.col(column).cast("string")) % modulus


def spread(*columns: str, seed: int = 7) -> Column:
    """A uniform number in [0, 1) from the columns: a repeatable random draw."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Offsets (n + 1) and values of the maximal runs of non-white-space, A-Z lower-cased; null counts as empty."""
    # Lower-cased before the cast: ascii_lower misreads arrays whose first offset is not zero, which casts of slices have.
    texts = pc.fill_null((pc.ascii_lower(texts) if lower else texts).cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    ends = parts.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    ends = ends - ends[0]
    return before[ends], flat.filter(full)


def batches(table: pa.RecordBatch, column: str, most_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts have about most_bytes together (a longer text stands alone)."""
    sizes = pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most_bytes:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def strings(values: pa.Array) -> list[str]:
    """Python strings; null as empty."""
    return pc.fill_null(values, "").to_pylist()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_least(pairs: DataFrame, rows: int) -> DataFrame:
    """(u, v, m): pairs (u, v) with m, the least v of u.  pairs: at most 2 * rows of them.

    A node of over a 256th of rows is a hub.  There are fewer than 512, so their minima are broadcast and their pairs stay
    where they are; a task of the join for the others gets no more than a 256th of rows for one node.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    few = F.col("n") <= rows / 256
    hubs = least.where(~few).select("u", F.col("m").alias("hub"))
    marked = pairs.join(F.broadcast(hubs), "u", "left")
    others = marked.where("hub is null").join(least.where(few).select("u", "m"), "u").select("u", "v", "m")
    return others.union(marked.where("hub is not null").select("u", "v", F.col("hub").alias("m")))


def linked_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node reachable.

    Alternates large-star and small-star steps, so rounds grow with the logarithm of the longest chain.
    A star step aggregates neighbours by min (partial before the shuffle) and joins the minimum back; a hub's
    rows are never collected.  Each step is cut by a checkpoint.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def print_of(x: DataFrame):
        return x.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    seen = print_of(e)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        starred = with_least(both, seen[0]).where("v > u")
        large = cut(starred.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        small = with_least(large, seen[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct())
        now = print_of(e)
        if tuple(now) == tuple(seen):
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge (node, smallest node reached) for each node: a star for each component of the given edges."""
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
