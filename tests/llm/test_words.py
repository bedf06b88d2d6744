"""Operators 11 to 13 and what they share, against brute force over the fixture's rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from wavemill.llm import collocations, decontamination, divergence
from wavemill.llm.fm_index import FmIndex
from wavemill.llm.words import byte_class, coded, split_words

ASCII = {i: i + 32 for i in range(65, 91)}


def lowered(text):
    return (text or "").translate(ASCII)


# words


@pytest.mark.parametrize("size", [1, 7, 1 << 22])
def test_split_words_are_those_of_the_pattern(monkeypatch, corpus, size):
    monkeypatch.setattr("wavemill.llm.words.SLICE_BYTES", size)
    texts = [r[1] for r in corpus] + ["end", "next", "", "É.È é\tA"]
    inside = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
    got = [[] for _ in texts]
    for first, w in split_words(pa.array(texts, pa.string()).slice(0), inside):
        codes, words = coded([w.text])
        assert words.take(pa.array(codes)).to_pylist() == w.text.to_pylist()
        for k, (row, word, s, e) in enumerate(zip(w.row, w.text.to_pylist(), w.start, w.end)):
            got[first + row].append(word)
            assert lowered(texts[first + row].encode()[s:e].decode()) == word
        assert [len(g) for g in got[first : first + len(w.counts)]] == w.counts.tolist()
    assert got == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t)) for t in texts]


def test_split_words_of_a_part_of_an_array_and_of_no_rows():
    inside = byte_class((0x61, 0x7A))
    texts = pa.array(["no", "a b", None, "c", "no"])
    (first, w), = split_words(texts.slice(1, 3), inside)
    assert (first, w.text.to_pylist(), w.row.tolist(), w.counts.tolist()) == (0, ["a", "b", "c"], [0, 0, 2], [2, 0, 1])
    assert list(split_words(texts.slice(0, 0), inside)) == []
    assert coded([])[0].tolist() == []


# 11


def phrases_of(rows, least):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, 5):
                    if i + m <= len(words):
                        counts[lang][tuple(words[i : i + m])] += 1
    return {k: {p: c for p, c in v.items() if c >= least} for k, v in counts.items()}, n


def collocations_of(rows, least, best):
    found, n = phrases_of(rows, least)
    out = []
    for lang, f in found.items():
        held = collections.defaultdict(int)
        for p, c in f.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(held[p[i : i + m]], c)
        kept = []
        for p, a in f.items():
            if len(p) == 1 or 100 * held[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def spoken(corpus):
    """The corpus with several languages, and a pair and a triple of words that are most of all."""
    rng = random.Random(3)
    rows = [(*r[:2], [None, "und", "en", "de"][k % 4], *r[3:]) for k, r in enumerate(corpus)]
    some = [f"w{i}" for i in range(6)]
    for i in range(60):
        text = "".join(rng.choice(some) + rng.choice([" ", " ", "  ", ", ", "\t", "\n", ". "]) + rng.choice(["Hot pair ", "hot pair of ", ""]) for _ in range(40))
        rows.append((1000 + i, text, "en" if i % 3 else None, "s1", None, *["clash"] * 15))
    return rows


@pytest.mark.parametrize("least,bucket", [(2, 1 << 20), (3, 50), (2, 400)])
def test_collocations_equal_brute_force(spark, spoken, least, bucket):
    from conftest import SCHEMA

    docs = spark.createDataFrame(spoken, SCHEMA).repartition(4)
    got = collocations.collocations(docs, least, 40, bucket).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    want = collocations_of(spoken, least, 40)
    assert want and sorted(tuple(r) for r in got) == want


def test_all_frequent_phrases_are_grown_wherever_prefixes_are_split(spark, spoken):
    from conftest import SCHEMA

    docs = spark.createDataFrame(spoken, SCHEMA).repartition(3)
    want, _ = phrases_of(spoken, 2)
    want = sorted((k, len(p), " ".join(p), c) for k, v in want.items() for p, c in v.items())
    for bucket in (30, 1 << 20):
        phrases, _ = collocations.frequent_phrases(docs, 2, bucket)
        assert sorted(tuple(r) for r in phrases.select("lang", "words", "phrase", "f").collect()) == want


def test_collocations_of_nothing(spark, empty, docs):
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(docs, 10**9).collect() == []


# 12


def audit_of(rows, least, top):
    counts, df, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        counts.update((lang, source, w) for w in words)
        df.update((lang, w) for w in set(words))
    kept = collections.defaultdict(set)
    for (lang, w), n in df.items():
        if n >= least:
            kept[lang].add(w)
    share = lambda n, total, v: 1 + 1_000_000_000 * (n + 5) // (total + 5 * v)
    p, out = {}, []
    for lang, source in groups:
        own = kept[lang]
        total = sum(counts[lang, source, w] for w in own)
        p[lang, source] = {w: share(counts[lang, source, w], total, len(own)) for w in own}
    for lang, source in groups:
        own = kept[lang]
        ranked = sorted((-sum(abs(p[lang, source][w] - p[lang, o][w]) for w in own), o.encode()) for k, o in groups if k == lang and o != source)
        out += [(lang, source, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(ranked, 1)]
        n = {w: sum(counts[lang, o, w] for k, o in groups if k == lang) for w in own}
        q = {w: share(n[w], sum(n.values()), len(own)) for w in own}
        better = sorted((q[w] - p[lang, source][w], w.encode()) for w in own if counts[lang, source, w] and p[lang, source][w] > q[w])
        out += [(lang, source, "term", w.decode(), -v, i) for i, (v, w) in enumerate(better[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def sourced(corpus):
    """The corpus over many sources, with a language without kept terms and groups without words."""
    rng = random.Random(5)
    rows = [(*r[:2], [None, "en", "de"][k % 3], r[3], *r[4:]) for k, r in enumerate(corpus)]
    for i in range(90):
        text = " ".join(rng.choice(["alpha", "beta", "Gamma", "ñandú", "x1y", "delta"]) for _ in range(rng.randrange(1, 30)))
        rows.append((2000 + i, text, "en", f"site{i % 11}", None, *["clash"] * 15))
    rows += [(3000, None, "en", "bare", None, *["clash"] * 15), (3001, "", "xx", "bare", None, *["clash"] * 15), (3002, "once", "xx", None, None, *["clash"] * 15)]
    return rows


@pytest.mark.parametrize("least,heavy,tile", [(2, 16, (1024, 64)), (2, 3, (4, 3)), (3, 0, (2, 2)), (2, 100, (8, 5)), (40, 4, (8, 5))])
def test_audit_equals_brute_force(spark, sourced, least, heavy, tile):
    from conftest import SCHEMA

    docs = spark.createDataFrame(sourced, SCHEMA).repartition(4)
    got = divergence.audit(docs, least, 7, heavy, tile).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(tuple(r) for r in got) == audit_of(sourced, least, 7)


def test_audit_of_nothing(spark, empty):
    assert divergence.audit(empty).collect() == []


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.sql("SELECT 9000000000000000000L AS n, 9000000000000000001L AS total, 3000000000L AS v")
    got = row.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (9 * 10**18 + 5) // (9 * 10**18 + 1 + 5 * 3 * 10**9)


# 13


def test_fm_index_finds_every_occurrence_in_its_document():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 5, 1, 200, 0, 200, 33, 0])
    codes = rng.integers(0, 3, sizes.sum())
    codes[206:406] = codes[6:206]  # a copy
    index = FmIndex.from_bytes(FmIndex.build(codes, sizes, 3).to_bytes())
    first = np.cumsum(sizes + 1) - sizes - 1
    docs = np.split(codes, np.cumsum(sizes)[:-1])
    phrases = [tuple(rng.integers(0, 3, rng.integers(1, 9))) for _ in range(300)] + [(2, -1), (-1,), tuple(docs[3][:150])]
    table = np.full((len(phrases), 150), -1)
    for i, p in enumerate(phrases):
        table[i, : len(p)] = p
    lo, hi = index.search(table, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, lo, hi):
        want = [first[k] + i for k, d in enumerate(docs) for i in range(len(d) - len(p) + 1) if tuple(d[i : i + len(p)]) == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


ITEMS = [
    (1, "alpha beta gamma delta one two three four five six seven eight"),
    (2, "Short item"),
    (10, "short, ITEM"),
    (3, ""),
    (4, None),
    (None, "nameless phrase"),
    (5, "alpha beta gamma delta one two three four five six"),
    (5, "other text of the same item"),
]


def screened(rows, items, window=10):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = collections.defaultdict(set)
    for item, text in items:
        w = re.findall(word, lowered(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases[tuple(w[i : i + window])].add("" if item is None else str(item))
    out = []
    for doc_id, text, *_ in rows:
        w = re.findall(word, lowered(text))
        hit, found = set(), set()
        for p, own in phrases.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found |= own
        out.append((doc_id, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leaked(corpus):
    rows = list(corpus)
    for i, text in enumerate(["x " + ITEMS[0][1] + " y", ITEMS[0][1].upper().replace(" ", ", "), "alpha beta gamma delta one two three four five", "short item short item", "nameless  phrase"]):
        rows += [(500 + i, text, "en", "s", None, *["clash"] * 15)] * (1 + i % 2)
    rows.append((600, ("pad " * 500 + ITEMS[0][1] + "! ") * 3, None, None, None, *["clash"] * 15))
    return rows


@pytest.mark.parametrize("shard,block", [(1_000_000, 200_000), (40, 2), (1, 1)])
def test_screen_equals_brute_force(spark, leaked, shard, block):
    from conftest import SCHEMA

    docs, items = spark.createDataFrame(leaked, SCHEMA).repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string")
    index = decontamination.build_index(docs, shard_words=shard)
    got = decontamination.screen_index(index, items, block=block).collect()
    rows = [(r.id, r.n_words, sum(s.stop - s.start for s in r.spans), ",".join(r["items"])) for r in got]
    assert sorted(rows, key=repr) == screened(leaked, ITEMS)
    assert all(a.stop < b.start for r in got for a, b in zip(r.spans, r.spans[1:]))


def test_passages_are_cut_from_first_to_last_word(spark, leaked):
    from conftest import SCHEMA

    docs, items = spark.createDataFrame(leaked, SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontamination.without_passages(docs, items)
    assert out.columns == docs.columns and out.count() == len(leaked)
    texts = {r.doc_id: r.text for r in out.where("doc_id >= 500").collect()}
    assert texts[500] == "x  y" and texts[501] == "" and texts[502] == "alpha beta gamma delta one two three four five" and texts[503] == "" and texts[504] == ""
    assert texts[600] == ("pad " * 500 + "! ") * 3
    clean = {(r[0], r[1]) for r in leaked if r[0] is None or r[0] < 500}
    assert {(r.doc_id, r.text) for r in out.where("doc_id is null or doc_id < 500").collect()} == clean


def test_screen_of_nothing(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.screen(empty, items).collect() == []
    none = decontamination.screen(docs, items.where("item_id = 3")).collect()
    assert len(none) == docs.count() and not any(r.spans or r["items"] for r in none)


def test_query_columns(spark, tmp_path, leaked):
    from conftest import SCHEMA

    from wavemill.llm import queries

    spark.createDataFrame(leaked, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    named = [x for x in ITEMS if x[0] is not None]
    spark.createDataFrame(named, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op13_decontamination(spark, str(tmp_path)).collect()
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got]
    want = [(d, n, h, len(i.split(",")) if i else 0, hashlib.sha256(i.encode()).hexdigest(), h > 0) for d, n, h, i in screened(leaked, named)]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
