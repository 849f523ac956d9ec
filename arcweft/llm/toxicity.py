"""Toxicity scores of a linear classifier with counterfactual regularisation.

Logistic regression over the presence of words.  For each labelled text that names a group of people, the group terms
are swapped for others of the same kind, and the squared change of the score's logit is penalised.  Thus weight on
group names costs, and neutral mentions are scored like any other text.

The fit reads a bounded sample of the labelled rows (about fit_rows, drawn by a hash of the id) and keeps at most
MOST_FEATURES words, those that tell the labels apart best, plus the group terms seen; scores are given to every whole
text.

Defined cases: null and empty texts get the score of a text without known words; null labels are left out; documents
labelled more than once count as often; with labels of one class only the score is that class's share, 0 if there are
none (next to it, as a probability); ties among words go by the word; extra columns pass on, but for those named like
the operator's own in any case of letters, which are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweft.llm.common import batches, free, kept_columns, tidy, words

FIT_ROWS, MOST_FEATURES, LEAST_DOCUMENTS = 20_000, 4096, 5
RIDGE, INVARIANCE, ROUNDS = 0.5, 1.0, 400
#: Power of the ratio of the classes by which rows of the rarer class weigh more.
BALANCE = 0.5
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„’‘…¡¿"
# Group terms by kind; a term is swapped for another of its line.
GROUPS = [
    "women men girls boys females males",
    "woman man girl boy female male",
    "muslims christians jews hindus buddhists atheists catholics protestants sikhs",
    "muslim christian jewish hindu buddhist atheist catholic protestant sikh",
    "islam christianity judaism hinduism buddhism",
    "gay straight lesbian bisexual transgender queer heterosexual homosexual",
    "gays lesbians heterosexuals homosexuals",
    "black white asian latino hispanic african arab european indigenous",
    "blacks whites asians latinos hispanics africans arabs europeans",
    "immigrants refugees migrants foreigners natives",
    "immigrant refugee migrant foreigner native",
    "mexicans americans chinese indians germans french spaniards turks poles russians",
    "blind deaf disabled autistic paralyzed",
    "old young elderly teenage",
    "frauen männer mädchen jungen",
    "muslime christen juden hindus buddhisten atheisten",
    "ausländer flüchtlinge einwanderer deutsche türken",
    "schwarze weiße asiaten afrikaner araber",
    "femmes hommes filles garçons",
    "musulmans chrétiens juifs hindous bouddhistes athées",
    "immigrés réfugiés étrangers arabes africains",
    "mujeres hombres niñas niños",
    "musulmanes cristianos judíos hindúes budistas ateos",
    "inmigrantes refugiados extranjeros árabes africanos",
]


def swaps() -> dict[str, str]:
    """Each group term's counterfactual: the next of its kind."""
    out: dict[str, str] = {}
    for line in GROUPS:
        terms = line.split()
        for i, x in enumerate(terms):
            out.setdefault(x, terms[(i + 1) % len(terms)])
    return out


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Document of each word, index of each word, and the distinct words, trimmed of punctuation and lower-cased."""
    offsets, values = words(texts, lower=False)
    coded = values.dictionary_encode()
    distinct = pc.utf8_lower(pc.utf8_trim(coded.dictionary, characters=PUNCTUATION))
    again = distinct.dictionary_encode()  # words that differed in case or punctuation meet again
    index = again.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), index, again.dictionary


class Model:
    """Words, their weights and a bias."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray, bias: float):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (document, word), each once."""
        owner, index, distinct = terms(texts)
        known = pc.fill_null(pc.index_in(distinct, value_set=pa.array(self.vocabulary, distinct.type)), -1).to_numpy(zero_copy_only=False)[index] if len(distinct) else np.zeros(0, np.int64)
        hit = known >= 0
        pairs = np.unique(owner[hit].astype(np.int64) * (len(self.vocabulary) + 1) + known[hit])
        return pairs // (len(self.vocabulary) + 1), pairs % (len(self.vocabulary) + 1)

    def score(self, texts: pa.Array) -> np.ndarray:
        doc, word = self.features(texts)
        z = self.bias + np.bincount(doc, self.weights[word], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _sample(docs: DataFrame, labels: DataFrame, train: Column, fit_rows: int, text_column: str, label_column: str, id_column: str) -> DataFrame:
    chosen = labels.where(train & F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).alias("__id"), F.col(label_column).cast("int").alias("label"))
    total = chosen.count()
    if total > fit_rows:
        chosen = chosen.where(F.pmod(F.xxhash64(F.lit(3), "__id"), F.lit(1 << 30)) < F.lit(int(fit_rows / total * (1 << 30))))
    # About fit_rows labels at most.  If their ids stand in more rows than that, the rows draw again, each for itself.
    chosen = F.broadcast(chosen)
    ids = docs.select(F.col(id_column).alias("__id"))
    rows = ids.join(chosen, "__id").count() if total else 0
    texts = docs.select(F.col(id_column).alias("__id"), F.col(text_column).cast("string").alias("text"), F.monotonically_increasing_id().alias("__place"))
    sample = texts.join(chosen, "__id")
    if rows > 2 * fit_rows:
        sample = sample.where(F.pmod(F.xxhash64(F.lit(5), "__id", "__place"), F.lit(1 << 30)) < F.lit(int(fit_rows / rows * (1 << 30))))
    return sample.select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, train: Column, fit_rows: int = FIT_ROWS, text_column: str = "text", label_column: str = "toxic", id_column: str = "doc_id") -> Model:
    """Fit on the labelled training rows; train is a condition on labels."""
    sample = _sample(docs, labels, train, fit_rows, text_column, label_column, id_column)

    @tidy
    def tallies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for a, b in batches(whole, "text"):
                batch = whole.slice(a, b - a)
                label = batch.column("label").to_numpy(zero_copy_only=False)
                owner, index, distinct = terms(batch.column("text"))
                n = len(distinct) + 1
                pairs = np.unique(owner.astype(np.int64) * n + index)
                hot = label[pairs // n] > 0
                both = [np.bincount(pairs[hot] % n, minlength=n - 1)[: n - 1], np.bincount(pairs[~hot] % n, minlength=n - 1)[: n - 1]]
                names = [distinct.cast(pa.string())] + [pa.array(x.astype(np.int64)) for x in both]
                yield pa.RecordBatch.from_arrays(names, names=["word", "hot", "cold"])
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([int((label > 0).sum())]), pa.array([int((label <= 0).sum())])], names=["word", "hot", "cold"])

    tally = sample.mapInArrow(tallies, "word string, hot bigint, cold bigint").groupBy("word").agg(F.sum("hot").alias("hot"), F.sum("cold").alias("cold"))
    swap = swaps()
    seen = tally.where("word is null or hot + cold >= %d" % LEAST_DOCUMENTS).where("word is null or word <> ''")
    whole = seen.where("word is null").first()
    hot, cold = (whole.hot, whole.cold) if whole else (0, 0)
    if not hot or not cold:
        share = hot / (hot + cold) if hot + cold else 0.0
        return Model(["\0"], np.zeros(1), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    smooth = lambda a, n: (F.col(a) + 0.5) / (n + 1.0)
    gap = F.abs(smooth("hot", hot) - smooth("cold", cold)) / F.sqrt((F.col("hot") + F.col("cold") + 1.0) / (hot + cold))
    strong = seen.where("word is not null").orderBy(gap.desc(), "word").limit(MOST_FEATURES).collect()
    vocabulary = sorted({r.word for r in strong} | set(swap))
    shape = Model(vocabulary, np.zeros(len(vocabulary)), 0.0)
    index = {w: i for i, w in enumerate(vocabulary)}
    swapped = np.array([index[swap[w]] if w in swap else i for i, w in enumerate(vocabulary)])

    @tidy
    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, b - a) for whole in it for a, b in batches(whole, "text")):
            doc, word = shape.features(batch.column("text"))
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([pa.array([word[at[i] : at[i + 1]].astype(np.int16).tobytes() for i in range(batch.num_rows)], pa.binary()), batch.column("label")], names=["words", "label"])

    rows = sample.mapInArrow(vectors, "words binary, label int").collect()  # bounded by fit_rows and MOST_FEATURES
    rows.sort(key=lambda r: (zlib.crc32(bytes(r.words)), bytes(r.words), r.label))  # the same fit whatever the order of partitions
    lists = [np.frombuffer(bytes(r.words), np.int16).astype(np.int64) for r in rows]
    y = np.array([float(r.label > 0) for r in rows])
    return Model(vocabulary, *_descend(lists, y, swapped, len(vocabulary)))


def _descend(lists: list[np.ndarray], y: np.ndarray, swapped: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Full-batch Adam on log loss + ridge + the mean squared change of the logit under the swap.

    The ridge is a prior on weights, the same whatever the number of rows, so it weighs more where there are few.
    """
    doc, word = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists) if lists else np.zeros(0, np.int64)
    moved = swapped[word] != word
    pair_doc, pair_from, pair_to = doc[moved], word[moved], swapped[word[moved]]
    odds = y.mean() / (1 - y.mean())
    w, b = np.zeros(n), float(np.log(odds) * (1 - BALANCE))
    each = np.where(y > 0, odds**-BALANCE, 1.0)
    each /= each.mean()
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, ROUNDS + 1):
        z = b + np.bincount(doc, w[word], minlength=len(y))
        error = each * (1 / (1 + np.exp(-z)) - y) / len(y)
        grad = np.bincount(word, error[doc], minlength=n) + RIDGE / len(y) * w
        if len(pair_doc):
            change = np.bincount(pair_doc, w[pair_from] - w[pair_to], minlength=len(y)) * (2 * INVARIANCE / len(y))
            grad += np.bincount(pair_from, change[pair_doc], minlength=n) - np.bincount(pair_to, change[pair_doc], minlength=n)
        g = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:n], b - step[n]
    return w, float(b)


def score(docs: DataFrame, model: Model, text_column: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= 0.5).  No shuffle; the model has at most some thousands of words."""
    own = ("score", "predicted")
    kept = [c for c in kept_columns(docs, *own) if keep_text or c.lower() != text_column.lower()]
    there = text_column in kept and docs.schema[text_column].dataType == T.StringType()
    text = text_column if there else free(docs, "text_of_row")
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b in batches(batch, text):
                part = batch.slice(a, b - a)
                p = model.score(part.column(text))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*kept, *own])

    return docs.select(*kept, *([] if there else [F.col(text_column).cast("string").alias(text)])).mapInArrow(run, schema)
