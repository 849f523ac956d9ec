"""Nearest neighbours by robust-pruned graphs, and near-duplicate vectors by a subspace pigeonhole join.

Vectors take part if they are not null, hold only finite numbers and are not zero; they are compared with vectors of
their own length only.

nearest: vectors are dealt by a hash of their content over shards of about SHARD distinct vectors.  Each shard holds a
directed graph: greedy searches from STARTS vectors propose neighbours, and a candidate is dropped where a kept
neighbour is closer to it, by a factor ALPHA, than the vector itself, so that long edges in other directions stay.
Every query searches each shard's graph with a beam; distances of what it finds are computed in double precision.  Of
exact copies the k + 1 smallest ids are kept with their vector: a query can need no more.

near_duplicates: copies of one vector are one, with their number.  Unit vectors are rotated and cut into blocks.  If two
differ by a squared distance of at most 2 - 2 * threshold, some block differs by no more than its share of it: each
block is joined by that range.  Its cells are the orthants of its first coordinates: a vector meets those vectors that
lie in a cell or within the range of its border.  Each pair found is verified once, in double precision, on the vectors
as they were given.  Which vectors come together at all is settled by pivots: a vector goes to the tiles of its nearest
pivot, and is compared with the tiles of another only if the triangle inequality lets a partner lie there.  The tiles of
a pivot hold TILE vectors each, however many it has, so no key is hot; a pair of tiles returns counts and a spanning
forest, never its pairs.

Defined cases: an empty table gives an empty result; identical rows count once; ties go to the smaller id; queries
that do not take part find nothing; rows whose vector does not take part link with nothing.  Of different vectors of one
id near_duplicates takes the least, nearest takes all.  Rows without an id take no part; near_duplicates returns each of
them with no links and no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweft.llm.common import cut, forest, linked_components, tidy

SHARD, QUERY_BLOCK, DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 16_384, 65_536, 24, 48, 160, 1.2
#: Nodes of a shard at which searches start, and nodes that a search expands at a time.
STARTS, EXPAND = 48, 8
#: Distinct vectors of a tile and a pivot, about; blocks at most; coordinates of a block's cells.
TILE, BLOCKS, CELL, SEED = 8192, 8, 8, 5


def usable(column: str = "embedding") -> Column:
    """Condition under which a row's vector takes part."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(column).isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(column, lambda x: x != 0), F.lit(False))


def by_length(df: DataFrame, each: int) -> DataFrame:
    """(len, parts, first): a row for each length of the vectors, with the numbers of its parts of about each vectors."""
    rows = df.groupBy(F.size("embedding").alias("len")).agg(F.ceil(F.count("*") / F.lit(each)).cast("int").alias("parts"))
    before = F.sum("parts").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, -1))
    return cut(rows.withColumn("first", F.coalesce(before, F.lit(0)).cast("int")))


def _beam(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, width: int, expand: int = EXPAND) -> tuple[np.ndarray, np.ndarray]:
    """The width nearest nodes found for each query by greedy search, and their squared distances."""
    q, n = len(queries), len(x)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # stands for no neighbour
    ids = np.full((q, width), n, np.int64)
    dist = np.full((q, width), np.inf, np.float32)
    done = np.ones((q, width), bool)
    norms = np.append((x**2).sum(1), np.float32(np.inf))
    own = (queries**2).sum(1)
    padded = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
    first = norms[starts][None] - 2 * (queries @ x[starts].T)
    k = min(len(starts), width)
    order = np.argsort(first, axis=1, kind="stable")[:, :k]
    seen[:, starts] = True
    ids[:, :k], dist[:, :k], done[:, :k] = starts[order], np.take_along_axis(first, order, 1), False
    while True:
        active = np.flatnonzero(~done.all(1))
        if not len(active):
            return ids, dist + own[:, None]
        r = active[:, None]
        pick = np.argsort(done[active], axis=1, kind="stable")[:, :expand]  # nearest that are not yet expanded
        nodes = np.where(done[r, pick], n, ids[r, pick])
        done[r, pick] = True
        near = graph[nodes].reshape(len(active), -1)
        fresh = np.where(seen[r, near], n, near)
        fresh.sort(axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
        seen[r, fresh] = True
        fresh.sort(axis=1)
        fresh = fresh[:, : max(1, int((fresh < n).sum(1).max()))]
        d = norms[fresh] - 2 * np.matmul(padded[fresh], queries[active][:, :, None])[:, :, 0]
        all_d = np.concatenate([dist[active], d], axis=1)
        top = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        top = np.take_along_axis(top, np.argsort(np.take_along_axis(all_d, top, 1), axis=1, kind="stable"), 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], fresh], axis=1), top, 1)
        dist[active] = np.take_along_axis(all_d, top, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], fresh == n], axis=1), top, 1)


def _prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of each point among its candidates (n: none), nearest first."""
    n = len(x)
    padded = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
    c = np.sort(np.where(candidates == points[:, None], n, candidates), axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = n
    v = padded[c]
    products = np.matmul(v, v.transpose(0, 2, 1))
    norms = np.einsum("bcc->bc", products)
    d = norms + (x[points] ** 2).sum(1)[:, None] - 2 * np.matmul(v, x[points][:, :, None])[:, :, 0]
    d = np.where(c == n, np.inf, np.maximum(d, 0))
    out, rows = np.full((len(points), degree), n, np.int64), np.arange(len(points))
    for k in range(degree):
        first = d.argmin(1)
        there = np.isfinite(d[rows, first])
        if not there.any():
            break
        out[there, k] = c[rows, first][there]
        gap = norms + norms[rows, first][:, None] - 2 * products[rows, first]
        d[alpha * alpha * gap <= d] = np.inf
        d[rows, first] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each vector (n: none) and the nodes at which searches start: the most central and some by chance.

    With many near copies the most central node lies among them, and their edges to each other leave few ways out.
    """
    n = len(x)
    rng = np.random.default_rng(SEED)
    center = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    starts = np.unique(np.append(rng.permutation(n)[: STARTS - 1], center))
    graph = np.full((n + 1, degree), n, np.int64)
    if n > 1:
        graph[:n, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    order = rng.permutation(n)
    for i in range(0, n, batch):
        p = order[i : i + batch]
        found, _ = _beam(x, graph, starts, x[p], max(width, len(starts)))
        graph[p] = _prune(x, p, np.concatenate([found, graph[p]], axis=1), degree, alpha)
        # Edges back: what does not fit into a neighbour's list is pruned with it.
        src, dst = np.repeat(p, degree), graph[p].reshape(-1)
        src, dst = src[dst < n], dst[dst < n]
        turn = np.argsort(dst, kind="stable")
        src, dst = src[turn], dst[turn]
        who, first, many = np.unique(dst, return_index=True, return_counts=True)
        wide = np.full((len(who), int(many.max(initial=0))), n, np.int64)
        wide[np.repeat(np.arange(len(who)), many), np.arange(len(dst)) - np.repeat(first, many)] = src
        by_many = np.argsort(many, kind="stable")  # lists of like length together
        for k in range(0, len(who), batch):
            some = by_many[k : k + batch]
            w = who[some]
            graph[w] = _prune(x, w, np.concatenate([graph[w], wide[some, : int(many[some].max())]], axis=1), degree, alpha)
    return graph[:n], starts


def build_index(vectors: DataFrame, k: int, id_column: str = "vec_id", column: str = "embedding", shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(shard, node, ids, vector, edges, start), a graph over all distinct vectors of each shard; and by_length() of the shards."""
    good = vectors.where(usable(column)).select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("embedding")).where("vec_id is not null").distinct()
    first = Window.partitionBy("embedding").orderBy("vec_id")
    # The limit on ids of one vector is applied before the shuffle, too.
    copies = good.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    copies = cut(copies)
    lengths = by_length(copies, shard)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ids", key=lambda s: s.map(lambda x: x[0]))  # the same graph whatever the order of rows
        whole = np.stack(part["embedding"].to_numpy())
        graph, starts = build_graph(whole.astype(np.float32))
        nodes = np.arange(len(whole))
        return pd.DataFrame({"shard": part["shard"].to_numpy(), "node": nodes, "ids": part["ids"].to_numpy(), "vector": [v.tobytes() for v in whole], "edges": [e.astype(np.int32).tobytes() for e in graph], "start": np.isin(nodes, starts)})

    dealt = copies.join(F.broadcast(lengths), F.size("embedding") == F.col("len"))  # a row for each length
    dealt = dealt.select("embedding", "ids", (F.col("first") + F.pmod(F.xxhash64("embedding"), F.col("parts"))).cast("int").alias("shard"))
    return cut(dealt.groupBy("shard").applyInPandas(build, "shard int, node int, ids array<long>, vector binary, edges binary, start boolean")), lengths


def search(index: DataFrame, lengths: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query (vec_id, embedding), itself left out."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    q = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).join(F.broadcast(lengths), F.size("embedding") == F.col("len"))
    q = q.select("vec_id", "embedding", "block", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("shard"))
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(nodes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if nodes.empty or asked.empty:
            return empty
        nodes = nodes.sort_values("node")
        kind = asked["embedding"].iloc[0].dtype
        whole = np.stack([np.frombuffer(v, kind) for v in nodes["vector"]]).astype(np.float64)
        x, n = whole.astype(np.float32), len(whole)
        graph = np.stack([np.frombuffer(e, np.int32) for e in nodes["edges"]]).astype(np.int64)
        graph = np.vstack([graph, np.full((1, graph.shape[1]), n)])
        ids, starts = nodes["ids"].to_numpy(), np.flatnonzero(nodes["start"].to_numpy())
        out_q, out_v, out_d = [], [], []
        for i in range(0, len(asked), 256):
            part = asked.iloc[i : i + 256]
            y = np.stack(part["embedding"].to_numpy()).astype(np.float64)
            found, _ = _beam(x, graph, starts, y.astype(np.float32), max(k + 1, min(beam, n)))
            for own, row, point in zip(part["vec_id"], found, y, strict=True):
                row = row[row < n]
                d = np.sqrt(((whole[row] - point) ** 2).sum(1))
                pairs = sorted((dd, int(v)) for dd, r in zip(d.tolist(), row, strict=True) for v in ids[r] if v != own)[:k]
                out_q += [own] * len(pairs)
                out_d += [a for a, _ in pairs]
                out_v += [b for _, b in pairs]
        return pd.DataFrame({"query_id": out_q, "vec_id": out_v, "score": out_d}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"}) if out_q else empty

    found = copies.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInPandas(find, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", column: str = "embedding", shard: int = SHARD) -> DataFrame:
    """The k nearest other vectors of each row that is a query."""
    index, lengths = build_index(vectors, k, id_column, column, shard)
    asked = vectors.where(usable(column)).where(is_query).select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("embedding")).where("vec_id is not null").distinct()
    return search(index, lengths, asked, k)


def rotation(size: int) -> np.ndarray:
    """A repeatable random rotation."""
    return np.linalg.qr(np.random.default_rng([SEED, size]).standard_normal((size, size)))[0]


def candidates(x: np.ndarray, y: np.ndarray, share: float, most_cells: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of x and y within one block whose squared distance is at most share (and some just beyond).

    Cells are orthants of the first coordinates.  A row of x lies in one; the rows of y that it meets are those whose
    coordinates on the other side of the cell's borders have squares of at most share together.
    """
    bits = np.arange(min(CELL, x.shape[1]))
    code = ((x[:, bits] > 0).astype(np.int64) << bits).sum(1)
    order = np.argsort(code, kind="stable")
    cells, start = np.unique(code[order], return_index=True)
    above = ((cells[:, None] >> bits) & 1).astype(np.float32)
    square, positive = y[:, bits] ** 2, y[:, bits] > 0
    beyond = above @ (square * ~positive).T + (1 - above) @ (square * positive).T
    one = lambda a: np.ones((len(a), 1), np.float32)
    # x.y - x.x/2 - y.y/2 is minus half the squared distance.
    left = np.hstack([x, -(x**2).sum(1, keepdims=True) / 2, one(x)])
    right = np.hstack([y, one(y), -(y**2).sum(1, keepdims=True) / 2])
    for c, (a, b) in enumerate(zip(start, np.append(start[1:], len(x)), strict=True)):
        guests = np.flatnonzero(beyond[c] <= share + 1e-5)
        if not len(guests):
            continue
        theirs, step = right[guests].T, max(1, most_cells // len(guests))
        for i in range(a, b, step):
            rows = order[i : min(b, i + step)]
            p, q = np.divmod(np.flatnonzero(left[rows] @ theirs >= np.float32(-share / 2 - 1e-5)), len(guests))
            if len(p):
                yield rows[p], guests[q]


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool, blocks: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of x and y whose cosine is at least threshold, each once; of one set with itself, i < j only."""
    size, budget = x.shape[1], 2 - 2 * threshold
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    turn = rotation(size)
    rx, ry = ((x / nx[:, None]) @ turn).astype(np.float32), ((y / ny[:, None]) @ turn).astype(np.float32)
    met = np.zeros(len(x) * len(y), bool)
    for columns in np.array_split(np.arange(size), blocks or max(1, min(BLOCKS, size // CELL))):
        for p, q in candidates(rx[:, columns], ry[:, columns], budget * len(columns) / size):
            if same:
                p, q = p[p < q], q[p < q]
            place = p * len(y) + q
            fresh = ~met[place]
            met[place[fresh]] = True
            p, q = p[fresh], q[fresh]
            for i in range(0, len(p), 20_000):  # verify
                a, b = p[i : i + 20_000], q[i : i + 20_000]
                hit = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
                if hit.any():
                    yield a[hit], b[hit]


def _unit(table: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each length in a batch: the length, the rows that have it, and their unit vectors."""
    lists = table.column(column)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), int(n))
        yield int(n), rows, x / np.linalg.norm(x, axis=1)[:, None]


def _tiled(vectors: DataFrame, reach: float, tile: int) -> DataFrame:
    """(a, b, own, vec_id, copies, embedding): vectors at the pairs of tiles in which a partner within reach may lie."""
    lengths = by_length(vectors, tile)
    # About one pivot for each tile that the vectors fill, drawn by a hash: N / tile vectors, which the driver holds.
    draw = Window.partitionBy(F.size("embedding")).orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id")
    drawn = vectors.select("embedding", F.size("embedding").alias("len"), F.row_number().over(draw).alias("n")).join(F.broadcast(lengths), "len").where("n <= parts").select("embedding").collect()
    pivots: dict[int, np.ndarray] = {}
    for n in {len(r.embedding) for r in drawn}:
        x = np.array([r.embedding for r in drawn if len(r.embedding) == n], np.float64)
        pivots[n] = x / np.linalg.norm(x, axis=1)[:, None]

    def distances(unit: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (unit @ pivots[unit.shape[1]].T), 0))

    @tidy
    def nearest_pivot(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for _, rows, unit in _unit(batch, "embedding"):
                d = distances(unit)
                cell[rows], far[rows] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    kept = [f"{c} {t}" for c, t in vectors.dtypes]
    placed = cut(vectors.mapInArrow(nearest_pivot, ", ".join([*kept, "cell int", "far double"])))
    tiles, radius, first = {}, {}, 0
    for r in placed.groupBy(F.size("embedding").alias("len"), "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).orderBy("len", "cell").collect():
        many = -(-r.n // tile)
        tiles.setdefault(r.len, {})[r.cell] = range(first, first + many)
        radius.setdefault(r.len, {})[r.cell] = r.far
        first += many

    @tidy
    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                cell, part = batch.column("cell").to_numpy(), batch.column("part").to_numpy()
                for n, rows, unit in _unit(batch, "embedding"):
                    d = distances(unit)
                    home = np.array([tiles[n][c][p % len(tiles[n][c])] for c, p in zip(cell[rows].tolist(), part[rows].tolist(), strict=True)])
                    for c, others in tiles[n].items():
                        near = (d[:, c] <= radius[n][c] + reach + 1e-6) | (cell[rows] == c)
                        if near.any():
                            mine = batch.select(["vec_id", "copies", "embedding"]).take(pa.array(rows[near]))
                            for other in others:
                                pair = [np.minimum(home[near], other), np.maximum(home[near], other), home[near]]
                                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in pair] + mine.columns, names=["a", "b", "own", *mine.schema.names])

    kind = dict(vectors.dtypes)["embedding"]
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).cast("int"))
    return dealt.mapInArrow(send, f"a int, b int, own int, vec_id long, copies long, embedding {kind}")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", column: str = "embedding", tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    every = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("embedding"))
    ids = every.where("vec_id is not null").select("vec_id").distinct()
    good = every.where(usable("embedding") & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # Copies are told by 128 bits of hashes, and go by the smallest of their ids.
    good = cut(good.withColumn("h", F.xxhash64("embedding")).withColumn("g", F.xxhash64(F.lit(SEED), "embedding")))
    groups = cut(good.groupBy("h", "g").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")))
    one = good.join(groups, ["h", "g"]).where("vec_id = first").select("vec_id", "copies", "embedding")

    def compare(table: pa.Table) -> pa.Table:
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        vec, own, copies = (table.column(c).to_numpy() for c in ("vec_id", "own", "copies"))
        x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), -1)
        i, j = np.flatnonzero(own == a), np.flatnonzero(own == b)
        counts, u, v = np.zeros(len(vec), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def settle() -> None:
            nonlocal counts, u, v, rows
            if held:
                p, q = (np.concatenate(z) for z in zip(*held, strict=True))
                counts += (np.bincount(p, copies[q], len(vec)) + np.bincount(q, copies[p], len(vec))).astype(np.int64)
                u, v = forest(np.concatenate([u, vec[p]]), np.concatenate([v, vec[q]]))
                held.clear()
                rows = 0

        if len(i) and len(j):
            for p, q in linked_pairs(x[i], x[j], threshold, a == b):
                held.append((i[p], j[q]))
                rows += len(p)
                if rows > 1_000_000:
                    settle()
            settle()
        hit = counts > 0
        return pa.table({"u": np.concatenate([vec[hit], u]), "v": np.concatenate([vec[hit], v]), "n": np.concatenate([counts[hit], np.zeros(len(u), np.int64)])})

    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    found = cut(_tiled(one, reach, tile).groupBy("a", "b").applyInArrow(compare, "u long, v long, n long"))
    links = found.where("n > 0").groupBy(F.col("u").alias("first")).agg(F.sum("n").alias("others"))
    component = linked_components(found.where("n = 0").select("u", "v")).select(F.col("node").alias("first"), "component")
    of = groups.join(links, "first", "left").join(component, "first", "left")
    of = of.select("h", "g", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    known = good.select("vec_id", "h", "g").join(of, ["h", "g"]).select("vec_id", "n_links", "component_id")
    out = ids.join(known, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    none = F.lit(None).cast("long")
    out = out.union(every.where("vec_id is null").select(none.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), none.alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
