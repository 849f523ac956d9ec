"""Exact token counts of a byte-level BPE tokenizer, by overlap resynchronisation.

A text longer than a chunk is encoded by the library in chunks that overlap, wherever their ends fall.  Each chunk gives
its tokens' offsets.  Two neighbours are spliced at a place of the overlap where both have a token boundary and that is
proven stable: between a character that is not white space and one that is.  The splitting pattern of the vocabulary
never takes white space after another character into one match and looks ahead only inside white space, so the tokens
on either side of such a place do not depend on what stands beyond it.  (The proof needs a vocabulary without a
normalizer whose added tokens hold no white space and take none along; others raise.)  If the overlap has no such place,
it is widened; at worst the left chunk grows, so that a run without white space is encoded as one.

A text of one chunk needs no splicing and goes another way, pieces(): it is cut at all its stable places, and the count
of a piece is reused wherever the piece stands again, so that the library sees a distinct piece about once a worker.

Defined cases: null and empty texts have 0 bytes and 0 tokens; special strings inside texts are handled as the library
does by default (a stable place never lies inside one); repeated rows are counted row by row; extra columns pass on, but
for those named like the operator's own in any case of letters, which are replaced.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweft.llm.common import batches, kept_columns, strings, tidy

#: Characters of a chunk and of the first overlap, pieces that a worker remembers, and characters of the longest of them.
CHUNK, OVERLAP, REMEMBERED, LONGEST = 32_768, 256, 300_000, 256
# The characters with Unicode's White_Space property.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES = frozenset(chr(x) for x in range(0x3001) if re.match(f"[{SPACE}]", chr(x)))
_PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_STABLE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


class Encoded:
    """The library's tokens of text[start:end], as places in the text, in order."""

    def __init__(self, tokenizer, text: str, start: int, end: int):
        offsets = tokenizer.encode(text[start:end], add_special_tokens=False).offsets
        both = np.array(offsets, np.int64).reshape(-1, 2) + start
        self.start, self.end, self.first, self.last = start, end, both[:, 0], both[:, 1]

    def before(self, place: int) -> int:
        """How many tokens begin before a place."""
        return int(np.searchsorted(self.first, place))

    def boundary(self, place: int) -> bool:
        """Whether no token lies across a place."""
        k = self.before(place)
        return k == 0 or self.last[k - 1] <= place


class Counter:
    """Counts tokens with a tokenizers file; made once per Python worker."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or any(_SPACES & set(x["content"]) or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("white space is no stable boundary with this vocabulary")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap, self.known = chunk, overlap, {}

    def encoded(self, text: str, start: int, end: int) -> Encoded:
        return Encoded(self.tokenizer, text, start, end)

    def count(self, text: str) -> int:
        """Tokens of one text of any length by overlapping chunks, holding two at a time."""
        n, total, spliced = len(text), 0, 0
        left = self.encoded(text, 0, min(n, self.chunk))
        while left.end < n:
            overlap = self.overlap
            while True:
                right = self.encoded(text, max(left.start, left.end - overlap), min(n, left.end + self.chunk))
                place = self.common(text, left, right, spliced)
                if place is not None:
                    break
                if right.start > left.start:
                    overlap *= 2
                else:  # no stable place at all: the left chunk itself grows
                    left, overlap = self.encoded(text, left.start, min(n, 2 * left.end - left.start)), self.overlap
                    if left.end == n:
                        return total + len(left.first) - left.before(spliced)
            total += left.before(place) - left.before(spliced)
            left, spliced = right, place
        return total + len(left.first) - left.before(spliced)

    def common(self, text: str, left: Encoded, right: Encoded, spliced: int) -> int | None:
        """A stable place inside the overlap that is a boundary of both chunks' tokens."""
        for found in _STABLE.finditer(text, right.start, left.end):
            x = found.start()
            if max(spliced, right.start) < x < left.end and left.boundary(x) and right.boundary(x):
                return x
        return None

    def pieces(self, text: str) -> list[str]:
        """A text cut at all its stable places."""
        return _PIECE.findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Have the library encode pieces that are not yet known."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [x for x in pieces if x not in self.known]
        # Pieces that begin with a space and end without any can stand one after another: each border is stable.
        joined, alone = [], []
        for x in new:
            (joined if x[0] == " " and x[-1] not in _SPACES and len(x) <= LONGEST else alone).append(x)
        for i in range(0, len(alone), 512):
            part = alone[i : i + 512]
            for x, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[x] = len(e)
        for i in range(0, len(joined), 2048):
            part = joined[i : i + 2048]
            starts = np.cumsum([0, *map(len, part)])
            offsets = self.tokenizer.encode("".join(part), add_special_tokens=False).offsets
            firsts = np.fromiter((a for a, _ in offsets), np.int64, len(offsets))
            # A token belongs to the piece that holds its first character.
            n = np.bincount(np.searchsorted(starts, firsts, side="right") - 1, minlength=len(part))
            self.known.update(zip(part, n.tolist(), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of several texts; the pieces of those of one chunk are learnt together."""
        split = [self.pieces(x) if len(x) <= self.chunk else None for x in texts]
        every = set().union(*(x for x in split if x))
        self.learn(every)
        known = self.known
        out = [self.count(text) if parts is None else sum([known[x] for x in parts]) for text, parts in zip(texts, split, strict=True)]
        for x in every:
            if len(x) > LONGEST:  # long pieces would fill the memory, and hardly come again
                del known[x]
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text_column: str = "text") -> DataFrame:
    """docs without the text, with n_bytes, n_tokens and over_limit (n_tokens > limit).  No shuffle."""
    own = ("n_bytes", "n_tokens", "over_limit")
    kept = kept_columns(docs, text_column, *own)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False), T.StructField("over_limit", T.BooleanType(), False)])

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in it:
            for a, b in batches(batch, text_column):
                part = batch.slice(a, b - a)
                texts = part.column(text_column)
                n = count.counts(strings(texts))
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[*kept, *own])

    return docs.select(*kept, F.col(text_column).cast("string").alias(text_column)).mapInArrow(run, schema)
