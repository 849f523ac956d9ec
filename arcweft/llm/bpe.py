"""BPE encoding and decoding by speculation and verification.

For each distinct word greedy longest match proposes tokens.  A sequence of tokens is what the ordered merges give
exactly if each token is itself what they give for its bytes and each adjacent pair is: no merge across a border would
have come before the merges that made the two tokens.  That check is done for all distinct pairs of a batch at once in
numpy.  Only words with a failing pair (or a character outside the vocabulary's base) go through exact merging.

Defined cases: null and empty texts have no tokens, and decode to an empty text; strings of the added tokens inside a
text become those tokens, as in the library; very long texts are handled word by word, and very long words are merged
by a heap; repeated rows are encoded row by row; extra columns pass on, but for those named like the operator's own in
any case of letters, which are replaced.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweft.llm.common import batches, kept_columns, strings, tidy

#: Words and their tokens that a worker remembers, about.
REMEMBERED, TOKENS = 200_000, 1_500_000
#: Symbols up to which a word's pairs are searched one after another for the least rank.
SHORT = 32
SUFFIX_BITS = 20
#: Characters by which the longest token that begins with them is looked up.
HEAD = 4
#: Stands for the word end in spelt words, so that no part of its spelling is matched by itself.
END = "\ue000"
NO_MERGE = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class WordBPE:
    """A lower-casing BPE vocabulary with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text_of = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.added.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): r for r, (a, b) in enumerate(merges)}
        self.made = [self.ids[a + b] for a, b in merges]  # by rank
        n = max(self.text_of) + 1
        self.born = np.full(n, -1, np.int64)  # rank of the merge that makes a token, -1 for base symbols
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for (a, b), r in self.rank.items():
            made = self.made[r]
            if self.born[made] < 0:
                self.born[made], self.left[made], self.right[made] = r, a, b
        keys = np.array([(a << SUFFIX_BITS) | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(self.rank.values()), np.int64)[order]
        self.alphabet = byte_alphabet()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace("\\s", "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"))
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        # Only tokens that merging gives for their own bytes may be proposed.
        added, end = set(self.added.values()), len(self.suffix)
        spelt = ((s[:-end] + END if end and s.endswith(self.suffix) and len(s) > end else s, i) for s, i in self.ids.items() if i not in added)
        self.base = {}
        self.proposed = {}
        for s, i in spelt:
            if self.born[i] < 0:
                self.base[s] = self.proposed[s] = i
            else:
                self.proposed[s] = i
        for s in [s for s, i in self.proposed.items() if self.born[i] >= 0 and self.merged(s) != [i]]:
            del self.proposed[s]
        self.reach: dict[str, int] = {}  # the longest token that begins with HEAD characters; without one, tokens are shorter
        for s in self.proposed:
            if len(s) >= HEAD:
                self.reach[s[:HEAD]] = max(self.reach.get(s[:HEAD], 0), len(s))
        self.index: dict[str, int] = {}
        self.flat, self.shown, self.start = array("i"), [], array("q", [0])
        self.table: np.ndarray | None = None

    def spell(self, word: str) -> str:
        """Byte characters of a word, then the word end."""
        if not word.isascii() or not word.isprintable() or " " in word:
            word = "".join([self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")])
        return word + END if self.suffix else word

    def merged(self, spelt: str) -> list[int]:
        """Exact merging of a spelt word or token: the merge of least rank, leftmost first, until none is left."""
        base = self.base
        parts = [base[c] for c in spelt[:-2]]
        parts += [base[spelt[-2:]]] if spelt.endswith(END) else [base[c] for c in spelt[-2:]]
        return self._merge_short(parts) if len(parts) <= SHORT else self._merge_long(parts)

    def _merge_short(self, parts: list[int]) -> list[int]:
        rank_of = self.rank.get
        ranks = list(map(rank_of, zip(parts, parts[1:]), repeat(NO_MERGE)))
        while ranks and (least := min(ranks)) != NO_MERGE:
            i = ranks.index(least)
            made = parts[i] = self.made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], made), NO_MERGE)
            if i < len(ranks):
                ranks[i] = rank_of((made, parts[i + 1]), NO_MERGE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same by a heap over linked symbols: n log n for words of any length."""
        rank, n = self.rank, len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank.get((a, b))) is not None]
        heapify(heap)
        while heap:
            least, i, a, b = heappop(heap)
            j = right[i]
            # A symbol that has been merged away is -1, and an entry counts only while both its symbols stand.
            if parts[i] != a or j == n or parts[j] != b:
                continue
            made = self.made[least]
            parts[i], parts[j] = made, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := rank.get((made, parts[k]))) is not None:
                    heappush(heap, (r, i, made, parts[k]))
            h = left[i]
            if h >= 0 and (r := rank.get((parts[h], made))) is not None:
                heappush(heap, (r, h, parts[h], made))
        return [p for p in parts if p >= 0]

    def speculate(self, spelt: str) -> list[int] | None:
        """Greedy longest match; None if some part has no token."""
        out, i, n, proposed, reach = [], 0, len(spelt), self.proposed, self.reach
        while i < n:
            for j in range(min(n, i + reach.get(spelt[i : i + HEAD], HEAD - 1)), i, -1):
                if (t := proposed.get(spelt[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                return None
        return out

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << SUFFIX_BITS) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of token a followed by those of b gives just (a, b), for arrays of pairs.

        Undo the later-made of the two border tokens step by step; at each state a merge across the border must not
        exist or must come no sooner than the merge that ended this state.
        """
        a, b = a.copy(), b.copy()
        ok, open_ = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)  # the state held until the merge of this rank
        strict = np.zeros(len(a), bool)  # merges of equal rank further left come first
        while len(open_):
            x, y = a[open_], b[open_]
            r = self.pair_rank(x, y)
            lim = limit[open_]
            bad = (r < lim) | ((r == lim) & strict[open_] & (r < np.iinfo(np.int64).max))
            ok[open_[bad]] = False
            open_, x, y = open_[~bad], x[~bad], y[~bad]
            bx, by = self.born[x], self.born[y]
            going = (bx >= 0) | (by >= 0)
            open_, x, y, bx, by = open_[going], x[going], y[going], bx[going], by[going]
            undo_left = bx >= by  # of equal ranks the left one was made first, so the right one is undone first
            undo_left &= bx != by
            limit[open_] = np.where(undo_left, bx, by)
            strict[open_] = ~undo_left
            a[open_] = np.where(undo_left, self.right[x], x)
            b[open_] = np.where(undo_left, y, self.left[y])
        return ok

    def learn(self, words: list[str]) -> None:
        """Encode words that are not yet known."""
        if len(self.index) > REMEMBERED or len(self.flat) > TOKENS:
            self.forget(words)
        new = [w for w in words if w not in self.index]
        if not new:
            return
        spelt = [self.spell(w) for w in new]
        guesses = [self.speculate(s) for s in spelt]
        failed = {k for k, g in enumerate(guesses) if g is None}
        owner = np.repeat(np.arange(len(guesses)), [len(g) if g else 0 for g in guesses])
        flat = np.fromiter((t for g in guesses if g for t in g), np.int64, len(owner))
        inside = owner[1:] == owner[:-1]
        if inside.any():
            keys, inverse = np.unique(((flat[:-1] << SUFFIX_BITS) | flat[1:])[inside], return_inverse=True)
            ok = self.compatible(keys >> SUFFIX_BITS, keys & ((1 << SUFFIX_BITS) - 1))
            failed |= set(owner[1:][inside][~ok[inverse]].tolist())
        for k, w in enumerate(new):
            ids = self.merged(spelt[k]) if k in failed else guesses[k]
            self.index[w] = len(self.shown)
            self.flat.extend(ids)
            self.start.append(len(self.flat))
            self.shown.append(" ".join([self.text_of[i] for i in ids]))
        self.table = None

    def forget(self, words: list[str]) -> None:
        """Forget all words but these: of what is known, those of the present run are the frequent ones."""
        index, flat, shown, start = self.index, self.flat, self.shown, self.start
        self.index, self.flat, self.shown, self.start, self.table = {}, array("i"), [], array("q", [0]), None
        for w in words:
            if (k := index.get(w)) is not None:
                self.index[w] = len(self.shown)
                self.flat.extend(flat[start[k] : start[k + 1]])
                self.start.append(len(self.flat))
                self.shown.append(shown[k])

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # Lower-cased character by character: without the rule for a final sigma.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """Words of a text in order; an added token stands as itself, marked by a leading NUL."""
        if self.special and any(x in text for x in self.added):
            out = []
            for k, part in enumerate(self.special.split(text)):
                out += ["\0" + part] if k % 2 else self.words.findall(self.normal(part))
            return out
        return self.words.findall(self.normal(text))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Token ids and decoded text of each text."""
        split = [self.split(t) for t in texts]
        every = set().union(*split) if split else set()
        marked = [w for w in every if w[0] == "\0" and w[1:] in self.added]
        self.learn([w for w in every if w not in marked])
        for w in marked:
            if w not in self.index:
                self.index[w] = len(self.shown)
                self.flat.append(self.added[w[1:]])
                self.start.append(len(self.flat))
                self.shown.append(w[1:])
                self.table = None
        if self.table is None:
            self.table, self.begin = np.array(self.flat, np.int64), np.array(self.start, np.int64)
        index, shown, out = self.index, self.shown, []
        for words in split:
            at = np.fromiter([index[w] for w in words], np.int64, len(words))
            n = self.begin[at + 1] - self.begin[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.table[np.repeat(self.begin[at] - (ends - n), n) + np.arange(total)] if total else np.zeros(0, np.int64)
            out.append((ids.astype("<u4"), " ".join([shown[i] for i in at.tolist()])))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text that the library's decode gives for ids (this vocabulary has no decoder: tokens joined by spaces)."""
        return " ".join([self.text_of[int(i)] for i in ids])


_MODELS: dict[str, WordBPE] = {}


def model(path: str) -> WordBPE:
    if path not in _MODELS:
        _MODELS[path] = WordBPE(path)
    return _MODELS[path]


def _run(docs: DataFrame, path: str, text_column: str, fields: list[T.StructField], make) -> DataFrame:
    own = [f.name for f in fields]
    kept = kept_columns(docs, text_column, *own)
    schema = T.StructType([docs.schema[c] for c in kept] + fields)

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in it:
            for a, b in batches(batch, text_column):
                part = batch.slice(a, b - a)
                columns = make(bpe.encode(strings(part.column(text_column))))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + columns, names=[*kept, *own])

    return docs.select(*kept, F.col(text_column).cast("string").alias(text_column)).mapInArrow(run, schema)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode_documents(docs: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """docs with ids (array of int) and decoded (text) instead of the text.  No shuffle."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False)]
    return _run(docs, path, text_column, fields, lambda x: [_ids(x), pa.array([s for _, s in x], pa.string())])


def token_documents(docs: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """docs with n_tokens, ids (array of int) and the SHA-256 of what they decode to instead of the text.  No shuffle."""
    fields = [T.StructField("n_tokens", T.LongType(), False), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded_sha256", T.StringType(), False)]
    return _run(docs, path, text_column, fields, lambda x: [_lengths(x), _ids(x), _decoded(x)])


def digest_documents(docs: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """docs with n_tokens and the SHA-256 of ids and decoded text instead of the text.  No shuffle."""
    fields = [T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)]
    return _run(docs, path, text_column, fields, lambda x: [_lengths(x), pa.array([sha256(i.tobytes()) for i, _ in x]), _decoded(x)])


def _lengths(x: list[tuple[np.ndarray, str]]) -> pa.Array:
    return pa.array([len(i) for i, _ in x], pa.int64())


def _ids(x: list[tuple[np.ndarray, str]]) -> pa.Array:
    ends = np.cumsum([0] + [len(i) for i, _ in x]).astype(np.int32)
    flat = np.concatenate([i for i, _ in x]).astype(np.int32) if x else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _decoded(x: list[tuple[np.ndarray, str]]) -> pa.Array:
    return pa.array([sha256(s.encode("utf-8", "surrogatepass")) for _, s in x])
