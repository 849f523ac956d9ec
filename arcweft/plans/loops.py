"""Loops of joins and aggregates: the one place where rounds are run and lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pieces of a growing state after which it is written as one.
PIECES = 8
MOST_ROUNDS = 100_000
#: Rows of a wave that one task may number.
SORTED_BY_ONE = 1_000_000
#: Rows of a few ids that every task may hold.
FEW = 250_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's spark.checkpoint.dir.  An own folder is set only where it is unset and one machine does all."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="arcweft-ckpt-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that plans do not grow and lost executors do no harm.

    Constraints are left out meanwhile: those that a checkpoint keeps can name columns that a later union lacks.
    """
    spark, key = df.sparkSession, "spark.sql.constraintPropagation.enabled"
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), in columns: a checkpoint's rows take some ten times the disk and are slow to read and write.

    The files lie in the checkpoint folder until drop() or the end of the application.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.deleteOnExit(at)
    if fs.getContentSummary(at).getLength() > 1 << 25:
        sc._jvm.System.gc()  # else shuffle files stay until the driver happens to collect its garbage
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = (fs, at)
    return out


def drop(*frames: DataFrame) -> None:
    """Delete what stored() wrote; no plan may read it again."""
    for fs, at in (x._stored_at for x in frames):
        fs.delete(at, True)


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, sent to all tasks of a join if it has no more than FEW rows; rows: their number, where it is known."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= FEW else df


def seeds_of(spark: SparkSession, seeds: DataFrame | Iterable[int]) -> DataFrame:
    """(seed, node) of a frame with column seed or id, or of a few ids."""
    if not isinstance(seeds, DataFrame):
        seeds = spark.createDataFrame([(int(x),) for x in seeds], "seed int")
    name = "seed" if "seed" in seeds.columns else "id"
    return seeds.select(F.col(name).alias("seed"), F.col(name).alias("node")).distinct()


def sources(edges: DataFrame) -> DataFrame:
    """(node, live): the nodes that edges lead away from."""
    return stored(edges.where("src <> dst").select(F.col("src").alias("node")).distinct().withColumn("live", F.lit(True)))


def expand(start: DataFrame, edges: DataFrame, most_rounds: int = MOST_ROUNDS, until: Column | None = None) -> DataFrame:
    """(seed, node, depth): hop distance from each seed's nearest start node, for all seeds in one loop.

    start: (seed, node); edges: (src, dst).  Only nodes new in a round that edges lead away from are joined in the next,
    and compared with what just their seeds have.  until: the loop ends early after a round that found a row for which
    this holds.
    """
    live = sources(edges)
    lead = few(live)
    flag = F.coalesce("live", F.lit(False)).alias("live")
    # All edges into a node lie in one task, which so counts a seed's ways there as one before they are dealt out.
    hops = edges.select("src", F.col("dst").alias("node")).where("src <> node").repartition("node").distinct()
    hops = stored(hops.join(lead, "node", "left").select("src", "node", flag))
    first = start.select("seed", "node").distinct().withColumn("depth", F.lit(0))
    parts = [stored(first.join(lead, "node", "left").select("seed", "node", "depth", flag))]
    # Where each seed starts at itself, nothing is found twice in the first round.
    own = parts[0].where("not (seed <=> node)").isEmpty()
    try:
        for depth in range(1, most_rounds + 1):
            frontier = parts[-1].where("live").select("seed", F.col("node").alias("src"))
            rows = frontier.count()
            if not rows:
                return _union(parts)
            if until is not None and depth > 1 and not parts[-1].where(until).isEmpty():
                return _union(parts)
            reached = hops.join(few(frontier, rows), "src").select("seed", "node", "live")
            if depth > 1 or not own:
                active = few(frontier.select("seed").distinct())
                known = _union(parts).select("seed", "node").join(active, "seed", "left_semi")
                reached = reached.distinct().join(known, ["seed", "node"], "left_anti")
            parts.append(stored(reached.select("seed", "node", F.lit(depth).alias("depth"), "live")))
            if len(parts) > PIECES:
                old = parts[:-1]
                parts = [stored(_union(old, "live")), parts[-1]]
                drop(*old)
    finally:
        drop(hops, live)
    raise RuntimeError("expand did not end")


def _union(parts: list[DataFrame], *more: str) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.select("seed", "node", "depth", *more)


def relax(start: DataFrame, edges: DataFrame, best: str = "min", most_rounds: int = MOST_ROUNDS) -> tuple[DataFrame, bool]:
    """(seed, node, value), and whether it settled: the least (or greatest) sum of w over walks from start values.

    start: (seed, node, value); edges: (src, dst, w).  Only improved rows are joined in the next round.
    """
    agg = F.min if best == "min" else F.max
    better = (lambda a, b: a < b) if best == "min" else (lambda a, b: a > b)
    steps = cut(edges.groupBy("src", "dst").agg(agg("w").alias("w")))
    state = cut(start.groupBy("seed", "node").agg(agg("value").alias("value")).withColumn("moved", F.lit(True)))
    for _ in range(most_rounds):
        delta = state.where("moved")
        offered = delta.join(steps, delta["node"] == steps["src"]).groupBy("seed", F.col("dst").alias("node")).agg(agg(F.col("value") + F.col("w")).alias("offer"))
        held = state.select("seed", "node", F.col("value").alias("old"))
        both = held.join(offered, ["seed", "node"], "full")
        moved = F.col("offer").isNotNull() & (F.col("old").isNull() | better(F.col("offer"), F.col("old")))
        # The state is written once a round, with a mark on what moved.
        state = cut(both.select("seed", "node", F.when(moved, F.col("offer")).otherwise(F.col("old")).alias("value"), moved.alias("moved")))
        if state.where("moved").isEmpty():
            return state.drop("moved"), True
    return state.drop("moved"), False


def ranked(df: DataFrame, group: list[str], order: list[Column], coarse: Column) -> DataFrame:
    """df with n, the number of a row within its group from 0.  coarse: a number that does not fall along the order.

    Rows are numbered within (group, coarse) and offset by the counts before, so no group is sorted in one task.
    """
    df = df.withColumn("__c", coarse)
    sizes = df.groupBy(*group, "__c").agg(F.count("*").alias("__k"))
    before = Window.partitionBy(*group).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__b", F.coalesce(F.sum("__k").over(before), F.lit(0))).drop("__k")
    within = Window.partitionBy(*group, "__c").orderBy(*order)
    out = df.withColumn("__r", F.row_number().over(within) - 1)
    cond = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "__c"]]
    joined = out.alias("l").join(sizes.alias("r"), cond)
    return joined.select("l.*", (F.col("__r") + F.col("__b")).cast("int").alias("n")).drop("__c", "__r")


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component) of every node of edges (src, dst) seen as undirected: the smallest node reachable.

    Alternating star contraction; the number of rounds grows with the logarithm of the longest path.
    """
    e = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", F.col("v").alias("c")).distinct())


def peel(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, pos): waves of nodes whose in-edges are all used up, in first-in-first-out order.

    nodes: (id); edges: (src, dst, adj_idx).  Nodes on or behind a cycle are absent.  A node's place follows that of
    its last used in-edge; the first wave is in order of id.  A round touches the wave's out-edges and the counts of
    nodes that still wait.
    """
    steps = cut(edges.select("src", "dst", "adj_idx"))
    open_ = steps.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("left"))
    none = F.lit(None).cast("struct<pos:int,adj_idx:int>")
    state = cut(nodes.select(F.col("id").alias("node")).join(open_, "node", "left").select("node", F.coalesce("left", F.lit(0)).alias("left"), none.alias("k")))
    out, level, offset = state.limit(0).select("node", F.lit(0).alias("level"), F.lit(0).alias("pos")), 0, 0
    while True:
        free = state.where("left = 0")
        size = free.count()
        if not size:
            return out
        order = F.col("node") if level == 0 else F.col("k")
        if size <= SORTED_BY_ONE:
            wave = free.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1)
        else:
            wave = ranked(free, [], [order], F.floor((F.col("node") if level == 0 else F.col("k.pos")) / F.lit(65536)))
        wave = cut(wave.select("node", F.lit(level).alias("level"), (F.col("n") + F.lit(offset)).cast("int").alias("pos")))
        out = wave if level == 0 else out.union(wave)
        if level % PIECES == PIECES - 1:
            out = cut(out)
        used = wave.join(steps, wave["node"] == steps["src"]).groupBy(F.col("dst").alias("d")).agg(F.count("*").alias("c"), F.max(F.struct("pos", "adj_idx")).alias("new"))
        rest = state.where("left > 0").join(used, F.col("node") == F.col("d"), "left")
        state = cut(rest.select("node", (F.col("left") - F.coalesce("c", F.lit(0))).alias("left"), F.greatest("k", "new").alias("k")))
        offset += size
        level += 1
