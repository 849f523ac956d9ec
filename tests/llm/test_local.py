"""Operators' kernels against libraries and plain Python, without Spark."""

from __future__ import annotations

import random
import re

import brute
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from arcweft.llm import bpe, html_text, language, simhash, token_counts, toxicity, vectors
from arcweft.llm.queries import tokenizer

TEXTS = ["", " ", "a  B c", "don't STOP\x1c!! x\x85y　z", "<|endoftext|> hi<|startoftext|>", "\n\n tab\t\tx ", "a" * 3000, "مرحبا 你好 😀 ok ½ İıΣς", "x " * 900 + "<|endo" + "ftext|>" * 3]


def fuzz(n):
    rng = random.Random(3)
    letters = "aabbcehlnorst тпρΣσİıéÉ .'’!?<|\x1c你😀0१½_-"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer

    path, texts = tokenizer("byte_bpe_50k.json"), TEXTS + fuzz(500)
    want = [len(e) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Counter(path).counts(texts) == want
    assert [token_counts.Counter(path, chunk=40, overlap=3).count(t) for t in TEXTS + fuzz(50)] == want[: len(TEXTS) + 50]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.WordBPE(path)
    rng = random.Random(5)
    texts = TEXTS + fuzz(800) + ["".join(rng.choice("aehlinorst") for _ in range(rng.randrange(30))) for _ in range(3000)]
    for text, e, (ids, shown) in zip(texts, library.encode_batch(texts, add_special_tokens=False), own.encode(texts), strict=True):
        assert ids.tolist() == e.ids, text
        assert shown == library.decode(e.ids, skip_special_tokens=False) == own.decode(ids)


def test_golay_keys_meet():
    rng = np.random.default_rng(2)
    a = rng.integers(-(2**63), 2**63 - 1, 1500, dtype=np.int64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(1, 5), replace=False).astype(np.uint64)) for _ in a], np.uint64)
    b = (a.view(np.uint64) ^ flips).view(np.int64)

    def keys(make):
        out = {}
        table = make(np.concatenate([a, b]))
        for k, f in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
            out.setdefault(f, set()).add(k)
        return lambda x: out.get(x, set())

    exact, filed, sought = keys(simhash.exact_keys), keys(simhash.filed_keys), keys(simhash.sought_keys)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert exact(x) & exact(y) or filed(x) & sought(y) or filed(y) & sought(x)


def fingerprint(text):
    w = brute.tokens(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    texts = [None, *TEXTS, *fuzz(200), "The quick brown fox jumps over the lazy dog"]
    table = pa.array(["skip", *texts])
    assert simhash.fingerprint_texts(table.slice(1)).view(np.uint64).tolist() == [fingerprint(t) for t in texts]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>Only one &amp; short</p>", "Only one & short"),
        ("<body><nav><a href=x>Home</a></nav><div class='sidebar'><p>Side, bar, with, many, commas, here.</p></div><article><h1>T</h1><p>One, two,\n three.<p>Four<br>five</article><div id=comments><p>Nice, post, really, good.</p></div><footer>(c)</footer>", "T One, two, three. Four five"),
        ("<script>if (a<b) document.write('<p>no, no, no</p>')</script><div class=content><p>Yes, this.</p><form><p>Join, now</p></form></div>", "Yes, this."),
        ("<div class='cookie-notice'>We, use, cookies, a, lot</div><main><p>Body text, long enough to count, is here.</p><aside>Ad</aside></main>", "Body text, long enough to count, is here."),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_deep_nesting_and_odd_markup():
    assert html_text.main_text("<div>" * 5000 + "deep, text" + "</div>" * 5000) == "deep, text"
    assert html_text.main_text("<p title='a>b'>x</p><p class=\"unclosed>y</p>").startswith("x")


def test_language_vectors_do_not_depend_on_batches():
    texts = ["Hello there", "", "123", "你好 world", "ñandú"] * 3
    whole = np.concatenate([v for _, v, _ in language.bundle(texts)])
    single = np.concatenate([v for t in texts for _, v, _ in language.bundle([t])])
    assert np.array_equal(whole, single)
    assert [bool(x) for _, _, f in language.bundle(texts[:5]) for x in f] == [True, False, False, True, True]


def test_counterfactual_penalty_moves_weight_off_groups():
    names = ["idiot", "muslims", "christians"]
    lists = [np.array(x, np.int64) for x in ([0, 1], [0, 1], [1], [2], [2], [], [0], [])]
    y = np.array([1.0, 1, 0, 0, 0, 0, 1, 0])
    w, _ = toxicity._descend(lists, y, np.array([0, 2, 1]), len(names))
    assert w[0] > 3 * abs(w[1]) and abs(w[1] - w[2]) < 0.3 * w[0]


def test_graph_search_recall():
    x = np.random.default_rng(1).standard_normal((1500, 32)).astype(np.float32)
    graph, start = vectors.build_graph(x)
    padded = np.vstack([graph, np.full((1, graph.shape[1]), len(x))])
    found, _ = vectors._beam(x, padded, start, x[:100], vectors.SEARCH_BEAM)
    want = np.argsort(((x[:100, None] - x[None]) ** 2).sum(2), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(found, want, strict=True)]) > 0.9


@pytest.mark.parametrize("blocks", [None, 1, 3, 20])
def test_linked_pairs_equal_brute_force(blocks):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 20))
    x[100:200] = x[:100] + 0.25 * rng.standard_normal((100, 20))
    found = [tuple(p) for a, b in vectors.linked_pairs(x, x, 0.9, True, blocks) for p in zip(a.tolist(), b.tolist(), strict=True)]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert len(found) == len(set(found)) and set(found) == {tuple(p) for p in np.argwhere(np.triu(u @ u.T >= 0.9, 1)).tolist()}
    other = [tuple(p) for a, b in vectors.linked_pairs(x[:150], x[150:], 0.9, False, blocks) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(other) == len(set(other)) and set(other) == {tuple(p) for p in np.argwhere(u[:150] @ u[150:].T >= 0.9).tolist()}


def test_words_split_on_ascii_white_space_only():
    from arcweft.llm.common import words

    offsets, values = words(pa.array([" A\x0bb\xa0C ", None, ""]))
    assert offsets.tolist() == [0, 2, 2, 2] and values.to_pylist() == ["a", "b\xa0C".lower()]
    assert re.findall(r"[^\x20\x09-\x0D]+", brute.lowered(" A\x0bb\xa0C ")) == values.to_pylist()


def test_words_of_slices():
    from arcweft.llm.common import words

    texts = ["Ünïcode É tÄxt", None, "", "más PALABRAS aquí"] * 50
    table = pa.array(texts)
    for a, b in ((0, 200), (1, 90), (77, 78), (150, 200)):
        for lower in (True, False):
            offsets, values = words(table.slice(a, b - a), lower)
            values.validate(full=True)
            want = [re.findall(r"[^\x20\x09-\x0D]+", brute.lowered(t) if lower else t or "") for t in texts[a:b]]
            assert values.to_pylist() == [w for ws in want for w in ws] and np.diff(offsets).tolist() == list(map(len, want))


LONG = "A long paragraph, which tells, at some length, what the page is about. " * 6


@pytest.mark.parametrize(
    ("page", "kept", "lost"),
    [
        (f"<div class='content-sidebar-wrap'><article><p>{LONG}</p></article><div class='sidebar'><p>Aside, here</p></div></div>", LONG, "Aside"),
        (f"<div class='has-sidebar'><div class='no-comments'><p>{LONG}</p></div></div><div id='comments'><p>Nice, post</p></div>", LONG, "Nice"),
        (f"<article><p>{LONG}</p></article><div id='comments'><article class='comment'><p>{'Nice, post. ' * 90}</p></article></div>", LONG, "Nice"),
        (f"<article><p>{LONG}</p></article><div class='related'><article><p>Teaser, one</p></article></div>", LONG, "Teaser"),
        ("<p>See <a href='/hidden/place'>the place</a>, now</p><p title='a hidden gem'>A gem, too</p><p hidden>Secret</p>", "See the place, now A gem, too", "Secret"),
    ],
)
def test_marks_do_not_take_the_article(page, kept, lost):
    text = html_text.main_text(page)
    assert kept.strip() in text and lost not in text


@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_short_parts_beside_a_long_one_stay(outer):
    parts = f"<section><p>Intro here.</p></section><h2>Head</h2><section>{f'<p>{LONG}</p>' * 6}</section><ul><li>Item</li></ul><p>Short.</p><section><p>The end.</p></section>"
    page = f"<body><nav><a href=x>Home</a></nav><{outer}>{parts}</{outer}><div><a href=y>More links to follow</a></div></body>"
    assert html_text.main_text(page) == f"Intro here. Head {' '.join([LONG.strip()] * 6)} Item Short. The end."
