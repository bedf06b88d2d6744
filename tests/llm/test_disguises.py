"""Disguises at the edges of words, and letters set apart."""

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wavemill.llm import toxicity

KNOWN = frozenset("worthless idiot clown pathetic moron stupid loser ass".split())


@pytest.fixture(scope="module")
def model():
    letters = toxicity._LATIN + "éñ"
    place = {c: i + 1 for i, c in enumerate(letters)}
    size = len(letters) + 2
    text = " ".join([*KNOWN, "you are such a kind person and this is a plain text with some of the usual words, señor café"] * 50)
    s = [place.get(c, size - 1 if c.isalpha() else 0) for c in text]
    counts = Counter((a * size + b) * size + c for a, b, c in zip(s, s[1:], s[2:]))
    return toxicity.LanguageModel(letters, counts)


@pytest.fixture(scope="module")
def restorer(model):
    return toxicity.Restorer(model, KNOWN)


def test_chances_sum_to_one(model):
    for a, b in ((0, 0), (1, 2), (19, 20), (27, 3), (model.size - 1, 0)):
        assert abs(sum(np.exp(model.chance(a, b, c)) for c in range(model.size)) - 1) < 1e-9


@pytest.mark.parametrize("word", ["1d10t", "w0r7h", "l0$3r!", "m.o.r.0.n", "st*p1d", "caf3", "señ0r", "gr0ß3", "aaa11", "x", "€€", "|||", "s t-u", "(l0wn"])
def test_viterbi_finds_the_best_of_all_paths(restorer, model, word):
    def chance(text):
        s, x, y = 0.0, 0, 0
        for c in text:
            k = model.symbol(c)
            if k or y:
                s += model.chance(x, y, k)
                x, y = y, k
        return s + model.chance(x, y, 0)

    paths = itertools.product(*toxicity._lattice(word))
    best = max(sum(cost for _, cost in p) + chance("".join(t for t, _ in p)) for p in paths)
    score, text = restorer.likeliest(word)
    assert abs(score - best) < 1e-9
    assert any(
        abs(sum(c for _, c in p) + chance(text) - best) < 1e-9 for p in itertools.product(*toxicity._lattice(word)) if "".join(t for t, _ in p) == text
    )


def test_counts_are_of_code_points(spark):
    docs = spark.createDataFrame([("Été été\nñ x",), ("",), (None,), ("ΩΩ 1",)], "text string")
    n = {chr(r["code"]): r["n"] for r in toxicity.letter_counts(docs).collect()}
    assert (n["é"], n["t"], n["ñ"], n["ω"], n["1"]) == (4, 2, 1, 2, 1)
    letters = toxicity.alphabet(toxicity.letter_counts(docs))
    assert letters == toxicity._LATIN + "éñω"
    size, place = len(letters) + 2, {c: i + 1 for i, c in enumerate(letters)}
    text = "\nété été\nñ x\n"
    want = Counter()
    s = [place.get(c, 0) for c in text]
    for t in zip(s, s[1:], s[2:]):
        want[(t[0] * size + t[1]) * size + t[2]] += 1
    got = {r["code"]: r["n"] for r in toxicity.character_counts(docs.limit(1), letters).collect()}
    assert got == want
    few = {r["code"]: r["n"] for r in toxicity.character_counts(docs.limit(1)).collect()}
    assert few[(27 * 28 + 20) * 28 + 27] == 2  # letters without a symbol of their own are one


def test_sparse_fit_is_the_dense_one():
    rng = np.random.default_rng(4)
    x = (rng.random((300, 12)) < 0.2).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] * 3 - x[:, 1] * 2 - 0.5)))).astype(float)
    w = toxicity.fit_logistic(*np.nonzero(x), y, 12, 0.1)
    z = np.hstack([x, np.ones((300, 1))])
    p = 1 / (1 + np.exp(-z @ w))
    assert np.abs(z.T @ (p - y) + np.array([0.1] * 12 + [1e-3]) * w).max() < 1e-6
    assert toxicity.fit_logistic(np.zeros(0, int), np.zeros(0, int), np.array([1.0, 0.0]), 0).shape == (1,)


@pytest.mark.parametrize(
    "word, want",
    [
        ("worthle$$", "worthless"), ("w0rthle$$!", "worthless"), ("a$$", "ass"), ("@$$", "ass"), ("(lown", "clown"), ("((lown)", "clown"),
        ("|oser", "loser"), ("*diot", "idiot"), ("loser!", "loser"), ("(loser)", "loser"), ("kind!", "kind"),
        ("(kind", "kind"), ("plain$", "plain"), ("some*", "some"), ("(a)", "a"), ("text|", "text"),
    ],
)
def test_edge_marks(restorer, word, want):
    assert restorer.read(word) == (want,)


@pytest.mark.parametrize(
    "text, found",
    [
        ("so i  d  i  o  t he", "idiot"), ("so i. d. i. o. t. he", "idiot"), ("m\n\no\n\nr\n\no\n\nn", "moron"), ("s - t - u - p - i - d", "stupid"),
        ("(c, l, o, w, n)", "clown"), ("an a s s he", "ass"), ("an @ s s he", "ass"), ("1 d 1 0 t", "idiot"), ("i d i o t", "idiot"),
    ],
)
def test_spaced_letters(restorer, text, found):
    assert found in toxicity.restored_words(pa.array([text]), restorer)[0]


def test_spaced_letters_end_with_the_text(restorer):
    got = toxicity.restored_words(pa.array(["such i d", "i o t kind", "", "1 1 1 1", "x - y"]), restorer)
    assert not any(KNOWN & words for words in got)
