"""Language-model scores by a Katz backoff model of any order, kept in partitioned tables and evaluated recursively.

Tokens are words with A-Z lower-cased, then one end; begins stand before the first word.  Seen n-grams have Good-Turing
discounted counts (counts up to MOST_DISCOUNTED, from the counts of counts of all training n-grams of that length); the
mass that this frees goes to the unseen words of the same history in proportion to the model of the shorter history, by
backoff weights that make every history's distribution sum to one exactly.  The unigram model, where the recursion ends,
is the base model (count + 1) / (N + V + 1): its last share is that of all unknown words.  A history that training never
had backs off with weight one.

    P(w | h) = d(c(h, w)) c(h, w) / c(h)   if c(h, w) > 0
             = a(h) P(w | h')              otherwise, with h' as h without its first word
    a(h)     = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w | h') over seen w)

A history whose followers all came more than MOST_DISCOUNTED times frees nothing by Good-Turing: it gives half a count of
each follower to unseen words, (c - 1/2) / c(h), so that no weight is zero.

How it runs: documents are read in chunks of about CHUNK tokens, coded by the chunk's own vocabulary and kept as
compressed arrays in the shared checkpoint folder.
1. Each chunk sends its vocabulary (64-bit hashes of words, training counts) to word partitions, which add the counts,
   number the words and answer with numbers and counts.
2. Level by level each chunk sends its distinct n-grams, with how often they stand in its training texts, to partitions
   by history.  A partition adds them up and answers for each n-gram with its count in all chunks, and for each history
   with whole numbers: its total, and how many of its followers have each low count, at this level and at the one below.
   All that the model needs follows from these, so a level is one pass and nothing is fitted on the driver.
3. With all answers, each chunk evaluates its n-grams from the unigrams up and adds up its documents.
What answers say of a history can be added up.  So a frequent history is dealt over several partitions by its followers'
words, as many as its count (which all chunks know from the level below) calls for, and each chunk adds their answers.
An n-gram costs a chunk one entry however often it stands there.  No step holds more than a chunk or a partition of a
table, and there are as many partitions as the tokens call for.

Words are told apart by 64-bit hashes (XXH64), histories exactly where the words' numbers fit into 62 bits together,
else by 63-bit hashes.

Defined cases: null and empty texts score the end after the begin; without training texts every word is unknown and
P = 1 / (0 + 0 + 1); repeated rows are texts of their own, also in equal partitions; a very long text is one chunk by
itself; a null id comes back null; an empty table gives no rows; extra columns do no harm.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweft.llm.common import batches, cut, give_back, tidy, words

ORDER = 2
#: Tokens of a chunk, of a word or history partition, and of a history from which on it is dealt over several, about.
CHUNK, PER_PARTITION, HOT = 1_000_000, 2_000_000, 500_000
MOST_DISCOUNTED = 5
END = 0xE0D  # stands for the hash of the end; no word has it but by chance of 2^-64
#: What is said of a history: its total, followers by count, followers by their count one level below, and of those
#: beyond MOST_DISCOUNTED there the sum of these counts and their number.
FACTS = 1 + MOST_DISCOUNTED + MOST_DISCOUNTED + 2


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes as the largest needs, as compressed planes."""
    x = np.ascontiguousarray(x).view(np.uint64) if x.dtype == np.int64 else x.astype(np.uint64)
    size = next(k for k in (1, 2, 4, 8) if k == 8 or x.max(initial=0) < 1 << 8 * k)
    planes = x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T
    return bytes([size]) + _zstd()[0].compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    """What was packed, as int64 (numbers of 64 bits wrap)."""
    size = data[0]
    planes = np.frombuffer(_zstd()[1].decompress(memoryview(data)[1:]), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(-1).astype(np.uint64).view(np.int64)


def gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 63-bit hash of pairs of integers."""
    x = np.asarray(a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def hashes(values: pa.Array) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in values.to_pylist()), np.uint64, len(values))


CHUNKS = "chunk long, rows binary, flags binary, sizes binary, vocabulary binary, seen binary, tokens binary, train long"
ASKED = "chunk long, part int, a binary, b binary, c binary, d binary, e binary"
ANSWERS = "chunk long, part int, a binary, b binary, c binary"


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(fields)})


def chunks(docs: DataFrame) -> DataFrame:
    """CHUNKS of (row, flag, text): documents coded by their chunk's vocabulary, hashes in order."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0
        # Equal chunks are chunks of their own: a partition's number and a running number tell them apart.
        key = itertools.count(TaskContext.get().partitionId() << 32)

        def flush() -> pa.RecordBatch:
            rows, flags, lengths = (np.concatenate([h[k] for h in held]).astype(np.int64) for k in range(3))
            values = pa.chunked_array([h[3] for h in held]).combine_chunks().dictionary_encode()
            known = hashes(values.dictionary)
            # Each document's words, then its end.
            sizes = lengths + 1
            tokens = np.full(int(sizes.sum()), len(known), np.int64)
            place = np.ones(len(tokens), bool)
            place[np.cumsum(sizes) - 1] = False
            tokens[place] = values.indices.to_numpy(zero_copy_only=False)
            every = np.append(known, np.uint64(END))
            order = np.argsort(every)
            turned = np.empty(len(order), np.int64)
            turned[order] = np.arange(len(order))
            tokens = turned[tokens]
            seen = np.bincount(tokens[np.repeat(flags % 2 == 0, sizes)], minlength=len(every))
            out = (next(key), rows.astype("<i8").tobytes(), *map(pack, (flags, sizes, gaps(every[order]), seen, tokens)), int(seen.sum()))
            return _rows(CHUNKS, [out]).to_batches()[0]

        for batch in it:
            for a, b in batches(batch, "text"):
                part = batch.slice(a, b - a)
                offsets, values = words(part.column("text"))
                held.append((part.column("row").to_numpy(zero_copy_only=False), part.column("flag").to_numpy(zero_copy_only=False), np.diff(offsets), values))
                total += len(values)
                if total >= CHUNK:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    return cut(docs.mapInArrow(run, CHUNKS))


def ask_words(coded: DataFrame, partitions: int) -> DataFrame:
    """Each chunk's words for the word partitions: equal ranges of hashes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                known, seen = np.cumsum(unpack(r["vocabulary"]).view(np.uint64), dtype=np.uint64), unpack(r["seen"])
                at = np.searchsorted(((known >> np.uint64(32)) * np.uint64(partitions)) >> np.uint64(32), np.arange(partitions + 1, dtype=np.uint64))
                rows = [(r["chunk"], p, pack(gaps(known[a:b])), pack(seen[a:b]), b"", b"", b"") for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
                yield from _rows(ASKED, rows).to_batches()

    return coded.select("chunk", "vocabulary", "seen").mapInArrow(run, ASKED)


def number_words(asked: pa.Table) -> pa.Table:
    """Numbers and training counts of one partition's words for each chunk, in the chunk's order, and how many are seen."""
    part, rows = asked.column("part")[0].as_py(), asked.to_pylist()
    known = [np.cumsum(unpack(r["a"]).view(np.uint64), dtype=np.uint64) for r in rows]
    every, inverse = np.unique(np.concatenate(known), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([unpack(r["b"]) for r in rows]), minlength=len(every)).astype(np.int64)
    facts = pack(np.array([(counts > 0).sum(), len(every)]))
    ends = np.cumsum([0] + [len(k) for k in known])
    out = []
    for r, a, b in zip(rows, ends[:-1], ends[1:], strict=True):
        mine = inverse[a:b]
        out.append((r["chunk"], part, pack(gaps(mine)), pack(counts[mine]), facts))
    return _rows(ANSWERS, out)


def tabulate(asked: pa.Table) -> pa.Table:
    """One partition of a level's table: adds up n-grams and answers each chunk."""
    part, rows = asked.column("part")[0].as_py(), asked.to_pylist()
    heads = [np.cumsum(unpack(r["a"])) for r in rows]
    fans, times, low = ([unpack(r[c]) for r in rows] for c in "bde")
    follow = []
    for r, fan in zip(rows, fans, strict=True):
        step = unpack(r["c"])
        total, some = np.cumsum(step), fan[fan > 0]
        follow.append(total - np.repeat(np.append(0, total)[np.cumsum(some) - some], some))
    histories, place = np.unique(np.concatenate(heads), return_inverse=True)
    word, fan, t = (np.concatenate(x) for x in (follow, fans, times))
    wide = int(word.max(initial=0)) + 1
    grams, at = np.unique(np.repeat(place, fan) * wide + word, return_inverse=True)
    count = np.bincount(at, t, minlength=len(grams)).astype(np.int64)
    below = np.zeros(len(grams), np.int64)
    below[at[t > 0]] = np.concatenate(low)
    # Of each history, over its followers seen in training.
    k, n = MOST_DISCOUNTED, len(histories)
    seen = count > 0
    h, c, d = grams[seen] // wide, count[seen], below[seen]
    by_count = np.bincount(h * (k + 2) + np.minimum(c, k + 1), minlength=n * (k + 2)).reshape(n, k + 2)
    by_below = np.bincount(h * (k + 2) + np.minimum(d, k + 1), minlength=n * (k + 2)).reshape(n, k + 2)
    beyond = np.bincount(h, np.where(d > k, d, 0), minlength=n)
    facts = np.vstack([np.bincount(h, c, minlength=n), by_count[:, 1 : k + 1].T, by_below[:, 1 : k + 1].T, beyond, by_below[:, k + 1]]).astype(np.int64)
    of = pack(np.bincount(np.minimum(c, k + 2), minlength=k + 3)[1 : k + 2])
    a_ends, b_ends = np.cumsum([0] + [len(x) for x in heads]), np.cumsum([0] + [len(x) for x in follow])
    out = []
    for i, r in enumerate(rows):
        mine = place[a_ends[i] : a_ends[i + 1]]
        out.append((r["chunk"], part, pack(facts[:, mine].reshape(-1)), pack(count[at[b_ends[i] : b_ends[i + 1]]]), of))
    return _rows(ANSWERS, out)


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing ratios d[r] for counts r up to MOST_DISCOUNTED, then 1; n[r - 1] is how many n-grams have count r.

    d = (r*/r - x) / (1 - x) with r* = (r + 1) n[r + 1] / n[r] and x = (k + 1) n[k + 1] / n[1].  Where few counts make
    a ratio leave (0, 1), or the table has no n-gram of some count, (r - 1/2) / r stands in, so that mass is left.
    """
    k = MOST_DISCOUNTED
    out = np.ones(k + 2)
    x = (k + 1) * n[k] / n[0] if n[0] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r] / n[r - 1] / r - x) / (1 - x) if n[r - 1] and x < 1 else math.nan
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Words:
    """The lowest level of a chunk: its words, by place in the vocabulary; the begin comes after the last."""

    def __init__(self, tokens: np.ndarray, answers: list[dict], partitions: int, trained: int, begins: int):
        facts = np.array([unpack(x["c"]) for x in answers]).reshape(-1, 2)
        self.numbers = np.concatenate([np.cumsum(unpack(x["a"])) * partitions + x["part"] for x in answers]) + 1
        #: One more than the greatest number of a word in any chunk.
        self.wide = int(facts[:, 1].max(initial=0)) * partitions + 2
        self.at, self.many = tokens, len(self.numbers)
        self.identity = np.append(self.numbers, 0)
        counts = np.concatenate([unpack(x["b"]) for x in answers])
        self.counts, self.everything = np.append(counts, begins), trained + int(facts[:, 0].sum()) + 1
        self.logs = np.log10((counts + 1.0) / self.everything)


class Grams:
    """The distinct n-grams of a chunk at one level above another, by history and word."""

    def __init__(self, below: Words | Grams, lowest: Words, first: np.ndarray, partitions: int, level: int):
        self.below, self.lowest, self.partitions, self.level = below, lowest, partitions, level
        before = np.empty(len(lowest.at), np.int64)
        before[1:] = below.at[:-1]
        before[first] = below.many
        keys, self.at = np.unique(before * lowest.many + lowest.at, return_inverse=True)
        self.history, self.word = np.divmod(keys, lowest.many)
        self.many = len(keys)
        self.suffix = np.empty(self.many + 1, np.int64)  # of each n-gram, what is left without its first word
        self.suffix[self.at] = below.at
        self.suffix[-1] = below.many
        fresh = np.diff(self.history, prepend=-1) != 0
        self.heads, self.mine = self.history[fresh], np.cumsum(fresh) - 1
        number = lowest.numbers[self.word]
        identity = below.identity[self.history]
        self.identity = np.append(identity * lowest.wide + number if lowest.wide**level < 1 << 62 else mixed(identity, number), 0)
        # Each history is asked for at one partition, or at several among which its followers are dealt.
        shares = np.minimum(1 + below.counts[self.heads] // HOT, partitions)
        start = np.cumsum(shares) - shares
        self.asked = np.repeat(np.arange(len(self.heads)), shares)
        head = below.identity[self.heads]
        part = (mixed(head, 1) % partitions)[self.asked] + np.arange(len(self.asked)) - start[self.asked]
        part %= partitions
        self.order = np.lexsort((head[self.asked], part))
        rank = np.empty(len(self.order), np.int64)
        rank[self.order] = np.arange(len(self.order))
        self.rank = rank[start[self.mine] + mixed(number, 2) % shares[self.mine]]
        self.turn = np.argsort(self.rank * lowest.wide + number)
        self.heads_sorted, self.part_sorted = head[self.asked][self.order], part[self.order]

    def ask(self, chunk: int, train: np.ndarray) -> pa.Table:
        """A row for each partition."""
        rank, number = self.rank[self.turn], self.lowest.numbers[self.word][self.turn]
        fan = np.bincount(rank, minlength=len(self.order))
        step = gaps(number)
        firsts = np.flatnonzero(np.diff(rank, prepend=-1))
        step[firsts] = number[firsts]
        times = np.bincount(self.at[train], minlength=self.many)[self.turn]
        low = self.below.counts[self.suffix[:-1]][self.turn]
        a = np.searchsorted(self.part_sorted, np.arange(self.partitions + 1))
        e = np.append(0, np.cumsum(fan))[a]
        rows = []
        for p in range(self.partitions):
            i, j, k, n = a[p], a[p + 1], e[p], e[p + 1]
            t = times[k:n]
            rows.append((chunk, p, pack(gaps(self.heads_sorted[i:j])), pack(fan[i:j]), pack(step[k:n]), pack(t), pack(low[k:n][t > 0])))
        return _rows(ASKED, rows)

    def learn(self, answers: list[dict]) -> None:
        """Counts, probabilities and backoff weights from the partitions' answers; logs of all n-grams."""
        k, heads = MOST_DISCOUNTED, len(self.heads)
        whose = self.asked[self.order]
        facts = np.hstack([unpack(x["a"]).reshape(FACTS, -1) for x in answers])
        facts = np.stack([np.bincount(whose, row, minlength=heads) for row in facts])
        counts = np.empty(self.many, np.int64)
        counts[self.turn] = np.concatenate([unpack(x["b"]) for x in answers])
        self.counts = np.append(counts, self.lowest.counts[-1])
        self.ratio = discounts(sum(unpack(x["c"]) for x in answers))
        self.total, by_count, by_below, beyond, many_beyond = facts[0], facts[1 : k + 1], facts[k + 1 : 2 * k + 1], facts[2 * k + 1], facts[2 * k + 2]
        r, d = np.arange(1, k + 1), self.ratio[1 : k + 1]
        known = self.total > 0
        self.bare = known & (by_count.sum(0) == 0)
        followers = by_below.sum(0) + many_beyond
        whole = np.where(known, self.total, 1)
        free = np.where(self.bare, followers / 2, (r * (1 - d)) @ by_count) / whole
        if self.level == 2:
            rest = (self.lowest.everything - (r @ by_below + beyond + followers)) / self.lowest.everything
        else:
            index = np.full(self.below.below.many + 1, -1)
            index[self.below.heads] = np.arange(len(self.below.heads))
            lower = index[self.below.suffix[self.heads]]
            t = np.maximum(self.below.total[lower], 1)
            rest = np.where(self.below.bare[lower], t - beyond + many_beyond / 2, t - beyond - (r * self.below.ratio[1 : k + 1]) @ by_below) / t
        weight = np.where(known, np.where(known, free, 1) / np.where(known, rest, 1), 1.0)
        seen, total = counts > 0, whole[self.mine]
        p = np.where(self.bare[self.mine], counts - 0.5, self.ratio[np.minimum(counts, k + 1)] * counts) / total
        self.logs = np.where(seen, np.log10(np.where(seen, p, 1)), np.log10(weight)[self.mine] + self.below.logs[self.suffix[:-1]])


def levels(row: dict, upto: int, partitions: int, trained: int, begins: int) -> tuple[Words, list[Grams], np.ndarray]:
    """A chunk's levels, learnt as far as it has answers, and the sizes of its documents."""
    tokens, sizes = unpack(row["tokens"]), unpack(row["sizes"])
    lowest = Words(tokens, row["level1"], partitions, trained, begins)
    out: list[Grams] = []
    for level in range(2, upto + 1):
        grams = Grams(out[-1] if out else lowest, lowest, np.cumsum(sizes) - sizes, partitions, level)
        if f"level{level}" in row:
            grams.learn(row[f"level{level}"])
        out.append(grams)
    return lowest, out, sizes


def score(docs: DataFrame, held_out: Column, text_column: str = "text", id_column: str = "doc_id", order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    order: the longest n-grams that count, 2 for bigrams.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    held = F.coalesce(held_out, F.lit(False)).cast("int")
    given = F.col(id_column).cast("long")
    coded = chunks(docs.select(F.coalesce(given, F.lit(0)).alias("row"), (held + 2 * given.isNull().cast("int")).alias("flag"), F.col(text_column).cast("string").alias("text")))
    size = coded.agg(F.sum("train")).first()
    trained = size[0] or 0
    partitions = max(1, -(-(trained + 1) // PER_PARTITION))

    def gathered(answers: DataFrame, level: int) -> DataFrame:
        return answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "a", "b", "c"))).alias(f"level{level}"))

    def begins_of(row: dict) -> int:
        """Training documents of all chunks: the count of the end, by which every document ends."""
        at = unpack(row["tokens"])[unpack(row["sizes"])[0] - 1]
        return int(np.concatenate([unpack(x["b"]) for x in row["level1"]])[at])

    def ask(level: int):
        def run(table: pa.Table) -> pa.Table:
            row = table.to_pylist()[0]
            _, grams, sizes = levels(row, level, partitions, trained, begins_of(row))
            out = grams[-1].ask(row["chunk"], np.repeat(unpack(row["flags"]) % 2 == 0, sizes))
            del grams, row
            give_back()
            return out

        return run

    def finish(table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        lowest, grams, sizes = levels(row, order, partitions, trained, begins_of(row))
        rows, flags = np.frombuffer(row["rows"], "<i8"), unpack(row["flags"])
        doc, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
        c = lowest.counts[lowest.at]
        base = np.bincount(doc, np.log10(c + 1.0), minlength=n) - sizes * math.log10(lowest.everything)
        out = {
            "doc_id": pa.array(rows, mask=flags >= 2),
            "held_out": flags % 2 == 1,
            "n_tokens": sizes,
            "n_known": np.bincount(doc[c > 0], minlength=n).astype(np.int64),
            "train_tokens": np.full(n, trained, np.int64),
            "base_score": base,
            "score": np.bincount(doc, grams[-1].logs[grams[-1].at], minlength=n),
        }
        del grams, lowest, row
        give_back()
        return pa.table(out)

    answers = ask_words(coded, partitions).groupBy("part").applyInArrow(number_words, ANSWERS)
    state = coded.select("chunk", "rows", "flags", "sizes", "tokens").join(gathered(answers, 1), "chunk")
    for level in range(2, order + 1):
        answers = state.groupBy("chunk").applyInArrow(ask(level), ASKED).groupBy("part").applyInArrow(tabulate, ANSWERS)
        state = state.join(gathered(answers, level), "chunk")
    return state.groupBy("chunk").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
