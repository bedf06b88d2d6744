"""Verdicts that must not rest on length."""

import random

from wavemill.llm import quality


def test_long_prose_is_kept(spark):
    rng = random.Random(5)
    words = [f"{rng.choice('bdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{i}" for i in range(3000)]
    weights = [1 / (i + 3) for i in range(3000)]
    prose = lambda n: " ".join(rng.choices(words, weights, k=n))
    dull = lambda n: " ".join(rng.choices(words[:200], k=n))
    texts = [prose(500), prose(30_000), dull(900), dull(30_000), prose(1_000) + " " + dull(5_000)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].base_failed for i in range(5)] == [False] * 5
    assert 4 * len(set(texts[1].split())) < 30_000
    assert [got[i].kept for i in range(5)] == [True, True, False, False, False]
