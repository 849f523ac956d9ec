"""Language identification with hyperdimensional profiles.

Each letter has a random bipolar vector, drawn from a seed and the letter itself.  The vector of a letter trigram binds
(multiplies) its letters' vectors, each permuted (rolled) by its place; a text's vector bundles (adds) those of its
trigrams; a language's prototype bundles the texts of that language.  A document gets the language whose prototype has
the greatest cosine with the document's vector.

Letters are lower-cased; every run of other characters counts as one blank.  The fit reads a bounded sample of the
labelled texts (about fit_rows, drawn row by row by a hash of id and place); prediction reads every whole text.

Defined cases: a null text or one without a letter gives `und` with score 0; ties go to the language of least name;
with no labelled text at all every document is `und`; repeated rows are treated alike; extra columns pass on, but for
those named like the operator's own in any case of letters, which are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweft.llm.common import batches, free, kept_columns, strings, tidy

DIMENSIONS, SEED, BLANK = 1024, 20, 32
#: Most rows of the fit's sample, about.
FIT_ROWS = 20_000


@cache
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)], bool)


@cache
def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


def bundle(texts: list[str], most_cells: int = 1_000_000, width: int = 2048) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first's index, their vectors (float32 rows), and whether each has a letter."""
    lowered = [" " + t.lower() + " " for t in texts]
    lengths = np.array([len(t) for t in lowered], np.int64)
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    del lowered
    letter = letter_table()[codes]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    lettered = np.bincount(owner[letter], minlength=len(texts)) > 0
    symbols = np.where(letter, codes, np.uint32(BLANK))
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != BLANK) | (symbols[:-1] != BLANK) | (owner[1:] != owner[:-1])
    symbols, owner = symbols[keep], owner[keep]
    seen = np.zeros(0x110000, bool)
    seen[symbols] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int32)
    place[alphabet] = np.arange(len(alphabet))
    s, n = place[symbols], len(alphabet)
    del codes, letter, symbols, keep, seen, place
    kind = np.int32 if n**3 < 1 << 31 else np.int64
    s = s.astype(kind)
    inside = owner[2:] == owner[:-2] if len(owner) > 2 else np.zeros(0, bool)
    grams = ((s[:-2] * kind(n) + s[1:-1]) * kind(n) + s[2:])[inside] if len(owner) > 2 else np.zeros(0, kind)
    owner = owner[: len(inside)][inside]
    if n**3 <= 1 << 21:  # a table of all trigrams of the letters at hand
        there = np.zeros(n**3, bool)
        there[grams] = True
        distinct = np.flatnonzero(there)
        index = np.zeros(n**3, np.int32)
        index[distinct] = np.arange(len(distinct))
        grams = index[grams]
    else:
        distinct, grams = np.unique(grams, return_inverse=True)
        grams = grams.astype(np.int32)
    letters = np.stack([letter_vector(int(c)) for c in alphabet]) if n else np.zeros((0, DIMENSIONS), np.int8)
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    rows = max(1, min(256, most_cells // max(1, min(width, len(distinct)))))
    bounds = np.searchsorted(owner, np.arange(0, len(texts) + rows, rows))
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for low in range(0, len(distinct), width):
        g = distinct[low : low + width]
        table = (first[g // (n * n)] * second[g // n % n] * letters[g % n]).astype(np.float32)
        for k, at in enumerate(range(0, len(texts), rows)):
            mine, who = grams[bounds[k] : bounds[k + 1]], owner[bounds[k] : bounds[k + 1]] - at
            if len(distinct) > width:
                part = (mine >= low) & (mine < low + width)
                mine, who = mine[part] - low, who[part]
            some = min(rows, len(texts) - at)
            counts = np.bincount(who.astype(np.int64) * len(g) + mine, minlength=some * len(g)).reshape(some, len(g)).astype(np.float32)
            out[at : at + some] += counts @ table
    for at in range(0, len(texts), rows):
        yield at, out[at : at + rows], lettered[at : at + rows]


def fit(docs: DataFrame, train: Column, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id", fit_rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """A unit prototype for each language of the training rows."""
    rows = docs.where(train & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    total = rows.count()
    if total > fit_rows:  # each row draws for itself, so that many rows of one id cannot all enter
        draw = F.xxhash64(F.lit(SEED), F.col(id_column), F.monotonically_increasing_id())
        rows = rows.withColumn("__draw", draw).where(F.pmod("__draw", F.lit(1 << 30)) < F.lit(int(fit_rows / total * (1 << 30))))

    @tidy
    def profiles(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in it:
            for a, b in batches(batch, "text"):
                langs = batch.column("lang").slice(a, b - a).to_pylist()
                for at, vectors, _ in bundle(strings(batch.column("text").slice(a, b - a))):
                    for lang in set(langs[at : at + len(vectors)]):
                        mine = [i for i, x in enumerate(langs[at : at + len(vectors)]) if x == lang]
                        sums[lang] = sums.get(lang, 0) + vectors[mine].astype(np.float64).sum(0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["lang", "sums"])

    def total_of(part: pd.DataFrame) -> pd.DataFrame:
        whole = sum(np.frombuffer(x, np.float64) for x in part["sums"])
        return pd.DataFrame({"lang": part["lang"].iloc[:1], "sums": [whole.tobytes()]})

    parts = rows.select(F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang")).mapInArrow(profiles, "lang string, sums binary")
    found = parts.groupBy("lang").applyInPandas(total_of, "lang string, sums binary").collect()  # a row for each language
    whole = {r.lang: np.frombuffer(bytes(r.sums), np.float64) for r in found}
    return {k: v / np.linalg.norm(v) for k, v in sorted(whole.items()) if np.linalg.norm(v) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_column: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with lang_pred and score (the cosine, 0 if negative).  No shuffle; the model has a row for each language."""
    own = ("lang_pred", "score")
    kept = [c for c in kept_columns(docs, *own) if keep_text or c.lower() != text_column.lower()]
    there = text_column in kept and docs.schema[text_column].dataType == T.StringType()
    text = text_column if there else free(docs, "text_of_row")
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
    names = sorted(prototypes)
    matrix = np.stack([prototypes[x] for x in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b in batches(batch, text):
                part = batch.slice(a, b - a)
                langs, scores = ["und"] * (b - a), np.zeros(b - a)
                for at, vectors, lettered in bundle(strings(part.column(text))):
                    norms = np.linalg.norm(vectors, axis=1)
                    if not names:
                        continue
                    cosines = (vectors @ matrix.T) / np.where(norms > 0, norms, 1)[:, None]
                    best = cosines.argmax(1)
                    for i in np.flatnonzero(lettered):
                        langs[at + i] = names[best[i]]
                        scores[at + i] = min(1.0, max(0.0, float(cosines[i, best[i]])))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(langs), pa.array(scores)], names=[*kept, *own])

    return docs.select(*kept, *([] if there else [F.col(text_column).cast("string").alias(text)])).mapInArrow(run, schema)
