"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the perfect binary Golay code
of length 23 (missing bits zero).  A word's keys are the indices of the codewords within 4 of it: one if a codeword is
within 2, else six.  Words that differ in at most two bits share a key; and the nearest codeword of a word is among
the keys of every word that differs from it in one bit.

Let two fingerprints differ in at most four bits, e1 + e2 + e3 <= 4 by segments.
* If some segment has no error, one of the other two has at most two: they meet in (exact segment, key of the other).
* Else two segments have exactly one error each.  Then the number of ones in each of these differs in parity.  The
  fingerprint with the even first segment is filed under its two nearest codewords; the odd one is looked up under all
  pairs of its keys; the second segment's parity goes into the key.
So no link is lost.  Candidates are verified in the join itself; links become a spanning forest of each task's rows
before they are shuffled, and components come from star contraction.  Copies meet at their one fingerprint.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any other; texts of one
to three words have one shingle; rows with a null id keep a fingerprint and component but never name one (a component
of them alone has a null name); repeated ids are compared row by row; of rows of one id and text one stays in
deduplicate; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweft.llm.common import batches, cut, forest, free, linked_components, tidy, words

SHINGLE, SEED, MOST_BITS = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
LENGTH, GENERATOR = 23, 0b101011100011  # of the Golay code


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits of a word, and for each syndrome the error patterns of the keys (-1: none)."""

    def remainder(v: int) -> int:
        for i in range(LENGTH - 1, 10, -1):
            if v >> i & 1:
                v ^= GENERATOR << (i - 11)
        return v

    bit = [remainder(1 << i) for i in range(LENGTH)]
    syndrome = lambda v: int(np.bitwise_xor.reduce([bit[i] for i in range(LENGTH) if v >> i & 1] or [0]))
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for table, shift in ((low, 0), (high, 12)):
        for v in range(1, len(table)):
            top = v.bit_length() - 1
            table[v] = table[v ^ (1 << top)] ^ bit[top + shift]
    patterns: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in combinations(range(LENGTH), weight):
            error = sum(1 << p for p in places)
            patterns[syndrome(error)].append(error)
    return low, high, np.array([p + [-1] * (6 - len(p)) for p in patterns], np.int64)


def segment_keys(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within 4 of each word, nearest first, and which of the six places are filled."""
    low, high, patterns = golay()
    errors = patterns[low[word & 0xFFF] ^ high[word >> 12]]
    return (word[:, None] ^ np.maximum(errors, 0)) >> 11, errors >= 0


def _parts(fingerprint: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    u = fingerprint.view(np.uint64)
    out = []
    for shift, bits in SEGMENTS:
        word = ((u >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        out.append((word, *segment_keys(word), np.bitwise_count(word).astype(np.int64) & 1))
    return out


def _table(keys: list[np.ndarray], fps: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(fps), pa.int64())], names=["key", "fp"])


def exact_keys(fp: np.ndarray) -> pa.RecordBatch:
    """(key, fp) by one exact segment and a key of another."""
    parts, keys, fps = _parts(fp), [], []
    for tag, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        word, (_, codes, filled, _) = parts[i][0], parts[j]
        whole = (np.int64(tag) << 34) | (word[:, None] << 12) | codes
        keys.append(whole[filled])
        fps.append(np.broadcast_to(fp[:, None], filled.shape)[filled])
    return _table(keys, fps)


def filed_keys(fp: np.ndarray) -> pa.RecordBatch:
    """(key, fp) by the nearest codewords of two segments, of fingerprints whose first of the two is even."""
    parts, keys, fps = _parts(fp), [], []
    for tag, (i, j) in enumerate(combinations(range(3), 2)):
        (_, a, _, pa_), (_, b, _, pb) = parts[i], parts[j]
        even = pa_ == 0
        keys.append(((np.int64(tag) << 34) | (a[:, 0] << 13) | (b[:, 0] << 1) | pb)[even])
        fps.append(fp[even])
    return _table(keys, fps)


def sought_keys(fp: np.ndarray) -> pa.RecordBatch:
    """(key, fp) by all pairs of keys of two segments, of fingerprints whose first of the two is odd."""
    parts, keys, fps = _parts(fp), [], []
    for tag, (i, j) in enumerate(combinations(range(3), 2)):
        (_, a, fa, pa_), (_, b, fb, pb) = parts[i], parts[j]
        filled = fa[:, :, None] & fb[:, None, :] & (pa_ == 1)[:, None, None]
        whole = (np.int64(tag) << 34) | (a[:, :, None] << 13) | (b[:, None, :] << 1) | (1 - pb)[:, None, None]
        keys.append(whole[filled])
        fps.append(np.broadcast_to(fp[:, None, None], filled.shape)[filled])
    return _table(keys, fps)


def fingerprint_texts(texts: pa.Array) -> np.ndarray:
    """Signed 64-bit fingerprints of whole texts."""
    offsets, values = words(texts)
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    if not len(values):
        return out.view(np.int64)
    # Every word with one space after it, as one buffer.
    spaced = pc.binary_join_element_wise(values, pa.scalar("", values.type), pa.scalar(" ", values.type))
    data = spaced.buffers()[2].to_pybytes()
    size = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size + 1) - 1
    begins = ends - size
    first = np.concatenate([np.arange(a, max(a + 1, b - SHINGLE + 1)) for a, b in zip(offsets[:-1], offsets[1:], strict=True) if b > a])
    owner = np.searchsorted(offsets[1:], first, side="right")
    last = np.minimum(first + SHINGLE, offsets[1:][owner]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(data[a:b], SEED) for a, b in zip(begins[first].tolist(), ends[last].tolist(), strict=True)], np.uint64, len(first))
    which, starts = np.unique(owner, return_index=True)
    for k in range(0, len(which), 64):
        a, b = starts[k], starts[k + 64] if k + 64 < len(which) else len(hashes)
        bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts[k : k + 64] - a, axis=0, dtype=np.int32)
        total = np.diff(np.append(starts[k : k + 64], b))
        out[which[k : k + 64]] = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out.view(np.int64)


def fingerprints(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, fp, print) of every row; print is a 64-bit hash of the text, which tells rows of one id apart."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b in batches(batch, "text"):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprint_texts(part.column("text"))), part.column("print")], names=["doc_id", "fp", "print"])

    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("print")).mapInArrow(run, "doc_id long, fp long, print long")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) that join exactly the fingerprints that are joined by links of MOST_BITS or fewer bits."""

    def keyed(make) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                fp = batch.column("fp").to_numpy(zero_copy_only=False)
                for i in range(0, len(fp), 4096):
                    yield make(fp[i : i + 4096])

        return distinct.mapInArrow(run, "key long, fp long")

    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MOST_BITS
    exact = keyed(exact_keys)
    one = exact.alias("a").join(exact.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near)
    two = keyed(filed_keys).alias("a").join(keyed(sought_keys).alias("b"), (F.col("a.key") == F.col("b.key")) & near)
    found = one.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).union(two.select(F.col("a.fp"), F.col("b.fp")))

    def trees(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in it:
            held.append((batch.column("u").to_numpy(zero_copy_only=False), batch.column("v").to_numpy(zero_copy_only=False)))
            rows += batch.num_rows
            if rows > 500_000:
                held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) > 250_000:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held.pop())), names=["u", "v"])
                rows = sum(len(x) for x, _ in held)
        if held:
            u, v = forest(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return found.mapInArrow(trees, "u long, v long")


def _labelled(marked: DataFrame, name: Column) -> DataFrame:
    """(fp, component) of every fingerprint: the least name that it reaches by links.

    name: an order over rows, other for rows of other fingerprints.  Fingerprints go by their least names, so that the
    least name of a component needs no gathering: it is what star contraction ends with.
    """
    named = cut(marked.groupBy("fp").agg(F.min(name).alias("name")))
    u, v = (named.select(F.col("fp").alias(x), F.col("name").alias(f"name_{x}")) for x in "uv")
    edges = links(named.select("fp")).join(u, "u").join(v, "v").select(F.col("name_u").alias("u"), F.col("name_v").alias("v"))
    found = linked_components(edges).select(F.col("node").alias("name"), "component")
    return named.join(found, "name", "left").select("fp", F.coalesce("component", "name").alias("component"))


def near_duplicates(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable by links."""
    marked = cut(fingerprints(docs, text_column, id_column).select("doc_id", "fp"))
    component = _labelled(marked, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp"))
    return marked.join(component, "fp").select("doc_id", "fp", F.col("component.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row of each group of near copies: that of the smallest id, null ids last.

    Rows are told apart by id and text, so that each group keeps one row whatever the ids.
    """
    marked = cut(fingerprints(docs, text_column, id_column))
    component = _labelled(marked, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print"))
    kept = component.select("component").distinct().select(F.col("component.doc_id").alias("id_kept"), F.col("component.print").alias("print_kept"))
    own = free(docs, "print_of_row")
    rows = docs.withColumn(own, F.xxhash64(F.col(text_column).cast("string")))
    rows = rows.join(kept, (F.col(own) == F.col("print_kept")) & F.col(id_column).cast("long").eqNullSafe(F.col("id_kept")), "left_semi")
    return rows.dropDuplicates([id_column, own]).drop(own)
