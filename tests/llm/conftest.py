import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, d string, th string, size string, key string, "
    "taken string, n_lines string, k_d string, b_id string, g_d string, t_slot string, w string, h string, piece string, n string, t string"
)


def row(doc_id, text, source="src"):
    return (doc_id, text, "en", source, None if text is None else len(text), *["clash"] * 15)


def prose(rng, n, words=400):
    return " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls in every column, empty and long texts, copies, near copies, shared lines and repeated rows."""
    rng = random.Random(7)
    shared = "This line of boilerplate stands in many documents."
    base = prose(rng, 300)
    long_text = "\n".join(prose(rng, 12) for _ in range(1500))
    texts = [prose(rng, rng.randrange(5, 200)) for _ in range(30)]
    texts += [base, base, base.replace(base.split()[40], "changed", 1), base + "\n" + shared, "\n" + shared + " \n" + prose(rng, 30), shared.upper()]
    texts += ["", None, " \t\n ", "a", "é ü ß", "\n\n", "x" * 500, "ab " * 300, long_text, long_text[:20000] + " end", "\0 zero\0", "one two"]
    rows = [row(i * 3 % 101, t, None if i % 9 == 0 else f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], row(None, texts[5]), row(None, None, None), (None, *[None] * 19)]
    rows += [row(200 + i, texts[2][:60] + f"\n{shared}\n" + prose(rng, 20), "hot") for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
