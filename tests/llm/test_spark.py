"""Operators on Spark: brute force on small tables, and defined cases."""

from __future__ import annotations

import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_local import fingerprint

from arcweft.llm import bpe, html_text, katz, language, mixing, simhash, token_counts, toxicity, vectors
from arcweft.llm.common import load, remainder
from arcweft.llm.queries import tokenizer

ROWS = [(1, None, None, None), (2, "", "en", "a"), (3, "The cat, an IDIOT.", "en", "a"), (3, "The cat, an IDIOT.", "en", "a"), (4, "¡Ñandú año! 123", "es", None), (5, "12 !!", None, "b"), (None, "the of and", "en", "b"), (6, "word " * 30_000, "en", "a")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, and extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in ("Score", "row", "fp", "label", "size", "target", "N_Tokens", "lang_pred", "part", "word", "__text", "text_of_row", "print", "component")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return load(spark, sf_dir, "documents")


@pytest.mark.parametrize(("order", "hot"), [(2, 200), (3, 50)])
def test_katz_equals_brute_force(docs, odd, monkeypatch, order, hot):
    monkeypatch.setattr(katz, "CHUNK", 15_000)
    monkeypatch.setattr(katz, "PER_PARTITION", 20_000)
    monkeypatch.setattr(katz, "HOT", hot)  # histories above it are dealt over several partitions
    both = docs.select("doc_id", "text").union(odd.where("doc_id is null or doc_id < 6").select(F.col("doc_id") + 10_000, "text").distinct())
    rows = both.collect()
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    want = dict(zip([r.doc_id for r in rows], brute.katz([r.text for r in rows], held, order), strict=True))
    got = katz.score(both, remainder("doc_id", 7) == 2, order=order).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3]) and r.score == pytest.approx(w[4])


@pytest.mark.parametrize("order", [2, 3])
def test_katz_distributions_sum_to_one(spark, order):
    """Over the vocabulary and one unknown word, after histories of frequent, rare and no followers."""
    texts = ["a b"] * 9 + ["a b c", "b c d a b", "d d d", "e", ""]
    model = brute.Katz(texts, [False] * len(texts), order)
    words = [*model.uni, "unknown"]
    for first in ("a", "b", "d", "e", "unknown"):
        history = ("",) * (order - 2) + (first,)
        assert sum(model.p(w, history) for w in words) == pytest.approx(1)
    asked = [f"{h} {w}" for h in ("a", "b", "d", "e", "unknown") for w in words if w]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + asked)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in katz.score(docs, F.col("doc_id") >= len(texts), order=order).collect()}
    want = brute.katz(texts + asked, [False] * len(texts) + [True] * len(asked), order)
    assert [got[i] for i in range(len(want))] == pytest.approx([w[4] for w in want])
    assert min(got.values()) > -30


def test_simhash_equals_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    fp = {r.doc_id: fingerprint(r.text) for r in rows}
    label = {i: i for i in fp}
    while True:
        new = {i: min(label[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 4) for i in fp}
        if new == label:
            break
        label = new
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fp % 2**64 for r in got} == fp
    assert {r.doc_id: r.component_id for r in got} == label
    kept = simhash.deduplicate(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(label.values()))


def test_vectors_equal_brute_force(spark, sf_dir):
    table = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in table.collect()}
    bad = spark.createDataFrame([(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [1.0]), (9005, []), (None, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    short = spark.createDataFrame([(9101, [1.0, 2.0, 3.0]), (9102, [1.0, 2.0, 3.0]), (9103, [1.0, 2.0, 3.1])], "vec_id long, embedding array<float>")
    whole = vectors.near_duplicates(table.union(bad).union(short).withColumn("n", F.lit(1)), 0.9, tile=60).collect()
    got = {r.vec_id: r for r in whole}
    assert len(whole) == len(got) + 1 and got[None].n_links == 0 and got[None].component_id is None
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (9001, 9002, 9003, 9004, 9005))
    assert all(got[i].n_links == 2 and got[i].component_id == 9101 for i in (9101, 9102, 9103))
    ids = sorted(x)
    m = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    near = (m @ m.T >= 0.9) & ~np.eye(len(ids), dtype=bool)
    assert [got[i].n_links for i in ids] == near.sum(1).tolist()
    label = np.array(ids)
    for _ in ids:
        label = np.minimum(label, np.where(near, label[None], 1 << 60).min(1))
    assert [got[i].component_id for i in ids] == label.tolist()
    found = vectors.nearest(table.union(bad), F.col("vec_id") % 5 == 0, 10, shard=100).collect()
    recall = []
    for q in [i for i in ids if i % 5 == 0]:
        want = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in ids if i != q)[:10]
        mine = sorted((r.rank, r.score, r.vec_id) for r in found if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        recall.append(len({i for _, _, i in mine} & {i for _, i in want}) / 10)
    assert np.mean(recall) >= 0.9


def test_mixing(docs):
    rows = mixing.mix_documents(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: r.size for r in rows} == {r.doc_id: len(brute.tokens(r.text)) for r in docs.collect()}
    assert all(r.taken <= 3 * r.size for r in rows)
    total, taken = {}, {}
    for r in rows:
        total[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert sum(total.values()) == pytest.approx(sum(r.size for r in rows))
    # Multinomial counts: with share p of n slots (of one word, in so small a table) within five standard deviations.
    n = sum(r.size for r in rows)
    assert all(abs(taken[s] - total[s]) <= 5 * (total[s] * (1 - total[s] / n)) ** 0.5 + 0.002 * total[s] for s in total)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix_documents(docs.repartition(3)).collect()) == sorted((r.doc_id, r.taken) for r in rows)


def test_targets_stop_at_three_times(spark):
    docs = spark.createDataFrame([(1, "a " * 10, "a"), (2, "b " * 1000, "b"), (3, "c " * 100, None), (4, None, "d")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_documents(docs).collect()}
    assert got[1].target == 30 and got[3].target == 300 and got[4].target == 0
    assert got[2].target == pytest.approx(1110 - 330)


def test_mixed_pieces_are_the_texts_words(spark):
    docs = spark.createDataFrame([(i, f"x{i} " * (40 + i), "s" + str(i % 2)) for i in range(6)], "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.mix_documents(docs).collect()}
    words = {}
    for r in mixing.mixed_pieces(docs).collect():
        assert set(r.text.split()) == {f"x{r.doc_id}"}
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert {k: v for k, v in taken.items() if v} == words


def test_language(docs, odd):
    model = language.fit(docs, remainder("doc_id", 3) != 1)
    held = language.predict(docs, model).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").where(remainder("doc_id", 3) == 1).collect()
    assert np.mean([r.lang_pred == r.truth for r in held]) > 0.95
    got = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 5)] == ["und"] * 3 and got[1].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.predict(odd, {}).collect()} == {"und"}


def test_toxicity(spark, sf_dir):
    docs, labels = load(spark, "/root/testdata/sf0.01", "documents"), load(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.fit(docs, labels, remainder("doc_id", 5) != 0)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(remainder("doc_id", 5) == 0).collect()
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(clean) < 0.05
    hot, cold = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    assert np.mean([a > b for a in hot for b in cold]) > 0.75
    plain = model.score(__import__("pyarrow").array(["the muslims and the women", "the christians and the men", None]))
    assert max(plain) < 0.5


@pytest.mark.parametrize("empty", [False, True])
def test_defined_cases(spark, odd, none, empty):
    df, n = (none, 0) if empty else (odd, len(ROWS))
    for made in (token_counts.count_tokens(df, tokenizer("byte_bpe_50k.json")), bpe.token_documents(df, tokenizer("word_bpe_49k.json")), language.predict(df, {}), toxicity.score(df, toxicity.Model(["\0"], np.zeros(1), 0.0))):
        names = [c.lower() for c in made.columns]
        assert len(names) == len(set(names)) and {"__text", "text_of_row", "word"} <= set(names)
    counts = token_counts.count_tokens(df, tokenizer("byte_bpe_50k.json")).collect()
    assert len(counts) == n and all(r.n_tokens == 0 for r in counts if r.doc_id in (1, 2))
    digests = bpe.digest_documents(df, tokenizer("word_bpe_49k.json")).collect()
    assert len(digests) == n and all(r.n_tokens == 30_000 for r in digests if r.doc_id == 6)
    assert html_text.extract(df.withColumnRenamed("text", "html")).count() == n
    marked = simhash.near_duplicates(df).collect()
    assert len(marked) == n and all(r.fp == 0 for r in marked if r.doc_id in (1, 2))
    assert len({r.component_id for r in marked if r.doc_id in (1, 2)}) == (0 if empty else 1)
    assert len(simhash.deduplicate(df).collect()) == (0 if empty else 6)
    assert mixing.mix_documents(df).count() == n
    assert katz.score(df, remainder("doc_id", 7) == 2).count() == n
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.score(df, toxicity.fit(df, labels, F.lit(True))).count() == n
    assert toxicity.score(df, toxicity.fit(df, labels.where("false"), F.lit(True))).count() == n
    assert language.predict(df, language.fit(df, F.lit(True))).count() == n


def test_empty_vectors(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(table).count() == 0
    assert vectors.nearest(table, F.col("vec_id") % 2 == 0).count() == 0


def test_copies_and_ties(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(100, [1.0, 2.1]), (101, [9.0, 9.0]), (101, [9.0, 9.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.nearest(table, F.col("vec_id") == 3, 10).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 0.0) for i in range(11) if i != 3]
    links = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(table, 0.999).collect()}
    assert links[5] == (30, 0) and links[100] == (30, 0) and links[101] == (0, 101) and len(links) == 32


@pytest.mark.parametrize("empty", [False, True])
def test_stages_of_odd_tables(spark, odd, none, empty, tmp_path):
    """Nulls, empty and long texts, repeats and clashing names: every column comes back, and no row is made up."""
    from arcweft.llm import stages

    spark.createDataFrame([(3, 1), (4, 0), (6, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = none if empty else odd
    given = {r.text for r in df.collect()}
    for stage in (stages.language_id, stages.toxic, stages.near_dedup, stages.mixing):
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
        rows = out.collect()
        assert {r.text for r in rows} <= given
        if stage is stages.language_id:
            lettered = {t for t in given if t and any(c.isalpha() for c in t)}
            assert {r.text for r in rows} <= lettered
            unknown = stage(spark, df.withColumn("lang", F.lit(None).cast("string")), "").collect()
            assert {r.text for r in unknown} == lettered
        if stage is stages.near_dedup and not empty:
            assert len(rows) == 6
    assert stages.encoding(spark, df, "").count() == df.count()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas(), docs.schema)
        assert docs.columns == columns and {r.doc_id for r in docs.select("doc_id").collect()} <= before, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count() > 0


def test_katz_tells_equal_chunks_apart(spark):
    texts = ["the cat sat on the mat", "a dog ran", "the cat ran on", "one two three"]
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 4 + 1).cast("int")).alias("text")
    same = spark.range(0, 8, 1, 2).select((F.col("id") % 4).alias("doc_id"), text)  # two partitions of the same rows
    nulls = spark.range(0, 4, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), text)
    for docs, all_texts in ((same, texts * 2), (nulls, texts)):
        got = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.score(docs, F.lit(False)).collect())
        want = sorted(brute.katz(all_texts, [False] * len(all_texts)))
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert g == pytest.approx(w)


def test_lm_scoring_of_a_history_with_one_frequent_follower(spark, tmp_path):
    from arcweft.llm.queries import op5_lm_scoring

    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(1000 + i, "alpha beta") for i in range(60)] + [(out, "alpha gamma")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in op5_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[out] > -20


def test_pipeline_keeps_clean_rows_without_own_ids(spark):
    from arcweft.llm import stages

    texts = ["the cat sat on the mat today", "a dog ran over the hill", "one two three four five six", "other words stand in this row", "last of all the texts here"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3]), (9, texts[4]), (9, texts[4])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = stages.near_dedup(spark, docs, "")
    assert sorted(r.text for r in kept.collect()) == sorted(texts)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["7", "7", "9", "None", "None"]
    assert {r.text for r in stages.mixing(spark, kept, "").collect()} == set(texts)
