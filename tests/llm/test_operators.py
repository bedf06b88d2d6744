"""Every operator against a brute-force twin, over rows with all the odd cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from wavemill.llm import fingerprints, licenses, line_dedup, mixing, near_dup, packing, quality, sharding, suffix_dedup, toxicity
from wavemill.llm.queries import SHARDS, tokenizer_path
from wavemill.llm.simhash import hex16

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = -(2**63)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def test_fingerprints(docs, corpus, empty):
    got = fingerprints.edited_fingerprints(docs).collect()
    assert len(got) == len(corpus)
    by_id = defaultdict(set)
    for r in corpus:
        by_id[LOW if r[0] is None else r[0]].add(r[1] or "")
    ids = sorted(by_id)
    follows = dict(zip(ids, ids[1:] + ids[:1]))
    want = Counter()
    for r in corpus:
        i = LOW if r[0] is None else r[0]
        if len(by_id[follows[i]]) == 1:  # else the text of the smallest hash follows
            t, nxt = r[1] or "", next(iter(by_id[follows[i]]))
            q = len(t) // 4
            want[r[0], len(t), sha(t[: len(t) - q] + nxt[:q])] += 1
    have = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got)
    assert not want - have
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    copies = {r.fp for r in got if r.doc_id in (90, 93)}
    assert len(copies) == 1
    for r in got:
        asked = r.doc_id is not None and r.doc_id % 50 == 0
        near = sum(bin((r.fp ^ x.fp) & (2**64 - 1)).count("1") <= 3 for x in got) - 1
        assert r.n_near == (near if asked else None)
    assert fingerprints.edited_fingerprints(empty).count() == 0


def voted(text):
    """The fingerprint of a text by a plain vote: word pairs weigh their code points."""
    w = re.split(r"[\x20\x09-\x0D]+", lower(text).strip(" \t\n\x0b\x0c\r"))
    votes, total = [0] * 64, 0
    for a, b in zip(w, [*w[1:], None]):
        h = xxhash.xxh64_intdigest(a, seed=42)
        h = h if b is None else xxhash.xxh64_intdigest(b, seed=h)
        n = len(a) + len(b or "")
        total += n
        for i in range(64):
            votes[i] += n * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * votes[i] > total)


def test_fingerprints_equal_a_plain_vote(docs, corpus):
    got = defaultdict(list)
    for r in fingerprints.edited_fingerprints(docs).collect():
        got[r.doc_id].append(r)
    unsigned = lambda fp: fp & (2**64 - 1)
    like = lambda a, b: 1 - bin(a ^ b).count("1") / 64
    by_id = defaultdict(set)
    for r in corpus:
        by_id[LOW if r[0] is None else r[0]].add(r[1] or "")
    ids = sorted(by_id)
    follows, edits = dict(zip(ids, ids[1:] + ids[:1])), 0
    for r in corpus:
        i, t = LOW if r[0] is None else r[0], r[1] or ""
        own = [g for g in got[r[0]] if g.n_chars == len(t) and unsigned(g.fp) == voted(t)]
        assert own, r[0]
        if len(by_id[follows[i]]) == 1:
            nxt = next(iter(by_id[follows[i]]))
            edited = voted(t[: len(t) - len(t) // 4] + nxt[: len(t) // 4])
            assert any(unsigned(g.edited_fp) == edited and g.near_edited == like(voted(t), edited) and g.near_next == like(voted(t), voted(nxt)) for g in own)
            edits += 1
    assert edits > 20


def test_block_tables_cover_the_radius():
    rng = np.random.default_rng(0)
    tables = fingerprints.block_tables(5, 3)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(flips & m & (2**64 - 1) == 0 for _, m in tables)


def test_licenses(spark, docs, corpus, empty):
    lines = [
        (1, "Some words.\nReleased under the MIT License.\nMore."),
        (2, "Licensed under CC BY-NC 4.0."),
        (3, "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except\nin compliance with the License."),
        (4, "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
        (5, None),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(1, 6)] == ["MIT", "CC-BY-NC-4.0", "Apache-2.0", "", ""]
    assert got[4].sentence_ids == "BSD-GRANT" and got[4].n_licenses == 0
    assert licenses.scan(docs).count() == len(corpus)
    assert licenses.scan(empty).count() == 0
    assert all(re.search(licenses.TRIGGER, s) for s in licenses._sentences())
    ids = set(licenses._sentences().values())
    assert all(set(r) <= ids for _, r in licenses.RULES)


def test_quality(docs, corpus, empty):
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
        for r in quality.judge(docs).collect()
    )
    want = Counter()
    for r in corpus:
        t = r[1] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeated = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        symbols = len(re.findall(r"[#*$%&|<>]", t))
        kept = not (
            failed or 10 * symbols > len(w) or 5 * (len(lines) - len(set(lines))) > 2 * len(lines) or 2 * t.count("!") > len(w)
            or 2 * sum(c.isupper() for c in t) > sum(map(len, w)) or 4 * sum(len(set(w[i : i + 1000])) for i in range(0, len(w), 1000)) < len(w)
        )
        want[r[0], len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated), failed, kept] += 1
    assert got == want
    assert quality.judge(empty).count() == 0


def test_distinct_words_are_counted_by_blocks(spark, tmp_path):
    """Texts of over a block, on both sides of the rule, and the SQL of the query on them."""
    import duckdb

    from wavemill.llm import queries

    cycle = lambda n, of: " ".join(f"w{i % of}x{i}" if of == 1 else f"w{i % of}" for i in range(n))
    texts = [cycle(3000, 600), cycle(3000, 200), cycle(1001, 251), cycle(1000, 249), cycle(1000, 250), cycle(2500, 1), cycle(40, 30)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op3_quality_rules(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(queries.OP3_SQL)
    names = queries.op3_quality_rules(spark, str(tmp_path)).columns
    assert got == sorted(want.select(*names).fetchall())


def test_quality_rules_by_rejection_per_cost(spark, docs, empty):
    """Costly rules that reject little come late, and the order does not hang on timing or partitions."""
    word = lambda i: f"{'bcdfg'[i % 5]}{'aeiou'[i // 5 % 5]}{'lmnrs'[i // 25 % 5]}"
    prose = [" ".join(word(i * k % 125) for i in range(100)) for k in (1, 2, 3, 4, 6, 7)]
    texts = prose + [p + " #$%" * 20 for p in prose[:3]] + [p + " !" * 150 for p in prose[:2]] + [prose[0].upper()]
    few = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = quality.estimate(few)
    assert [(name, round(12 * share)) for name, _, share in order] == [
        ("symbols", 3), ("exclamations", 2), ("capitals", 1), ("repeated lines", 0), ("few distinct words", 0),
    ]
    gain = [share / cost for _, cost, share in order]
    assert gain == sorted(gain, reverse=True) and order[0][1] == order[3][1] == 2 < 100 < order[4][1]
    assert order == quality.estimate(few.repartition(7)) == quality.estimate(few)
    assert len(quality.estimate(docs, sample_rows=10)) == len(quality.estimate(empty)) == 5


def test_toxicity(spark, docs, corpus, empty):
    bad = "worthless idiot clown pathetic moron stupid loser".split()
    rows, labels = [], []
    rng = np.random.default_rng(3)
    for i in range(600):
        toxic = i % 4 == 0
        words = " ".join(f"w{rng.integers(500)}x" for _ in range(40))
        rows.append((i, words + (" " + " ".join(rng.choice(bad, rng.integers(1, 3), replace=False)) if toxic else ""), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, "He is an 1d10t and W0RTHL3SS", "en", "s", 1), (1001, "so s t u p i d of you", "en", "s", 1), (1002, None, None, None, None)]
    rows += [(1003, "such a stuuuupid m.o.r.o.n", "en", "s", 1), (1004, "w1x w2x w3x", "en", "s", 1), (None, "pathetic", None, None, None)]
    labels += [(None, 1, 1), (5, 1, None), (7, None, 0)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(t, y).collect()}
    assert len(got) == len(rows)
    for i, _, toxic in labels[:600]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == toxic
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003, 1004)] == [1, 1, 0, 1, 0]
    assert got[None].predicted == 1 and not got[None].held_out
    kept = {r.doc_id for r in toxicity.without_toxic(t, y).collect()}
    assert kept == {i for i, r in got.items() if r.predicted == 0}
    assert toxicity.score_documents(docs, y.limit(0)).where("score > 0.5").count() == 0
    assert toxicity.without_toxic(docs, y).columns == docs.columns
    assert toxicity.score_documents(empty, y).count() == 0


def test_line_dedup(docs, corpus, empty):
    strip = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for r in corpus:
        for line in (r[1] or "").split("\n"):
            key = lower(line.strip(strip))
            if len(key) >= 20:
                holders[key].add(LOW if r[0] is None else r[0])
    want = Counter()
    for r in corpus:
        i, lines = LOW if r[0] is None else r[0], (r[1] or "").split("\n")
        left = [x for x in lines if len(holders.get(lower(x.strip(strip)), ())) < 3 or max(holders[lower(x.strip(strip))]) == i]
        want[r[0], len(lines), len(lines) - len(left), sha("\n".join(left))] += 1
    done = line_dedup.drop_common_lines(docs)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, sha(r.text or "")) for r in done.collect())
    assert got == want
    assert sum(n for (_, _, d, _), n in got.items() if d) > 30
    assert line_dedup.drop_common_lines(empty).count() == 0


def test_mixing(docs, corpus, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus)
    size, taken = Counter(), Counter()
    for r in corpus:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    left, full = sum(size.values()), set()
    while True:
        level = (left - 3 * sum(size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and level * weight[s] > 3 * size[s]}
        if not more:
            break
        full |= more
    for r in got:
        target = 3 * size[r.source] if r.source in full else level * weight[r.source]
        assert abs(r.target - target) < 1e-6 and r.source_size == size[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        # rows that repeat as a whole share one place in the order, so they are cut alike
        assert abs(taken[s] - min(level * weight[s], 3 * size[s])) < 1
    key = lambda rows: Counter((r.doc_id, r.source, r.size, r.taken) for r in rows)
    assert key(got) == key(mixing.mix(docs.repartition(2)).collect())
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_sharding(spark, docs, corpus, empty):
    table = sharding.lookup_table(SHARDS)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    # the same turns, by sorting claims: each shard's n-th turn takes its first slot that is still free
    small, size = SHARDS[:5], 101
    free, walk = set(range(size)), {}
    for s in small:
        m = hashlib.md5(s.encode()).digest()
        start, step = int.from_bytes(m[:8], "big") % size, int.from_bytes(m[8:], "big") % (size - 1) + 1
        walk[s] = [(start + i * step) % size for i in range(size)]
        assert sorted(walk[s]) == list(range(size))
    want = {}
    while free:
        for s in small:
            if free:
                slot = next(x for x in walk[s] if x in free)
                free.remove(slot)
                want[slot] = s
    assert [small[i] for i in sharding.lookup_table(small, size)] == [want[i] for i in range(size)]
    moved = sum(a != b for a, b in zip(table, sharding.lookup_table(SHARDS[:-1])))
    assert moved < len(table) / 16
    got = sharding.place(docs, SHARDS).collect()
    for r in got:
        h = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16)
        assert (r.slot, r.shard) == (h % 65537, SHARDS[table[h % 65537]])
    assert len(got) == len(corpus) and sharding.place(empty, SHARDS).count() == 0


def test_write_shards(spark, docs, corpus, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), SHARDS[:3], files=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(corpus)


def test_suffix_dedup(docs, corpus, empty):
    rows = sorted({(LOW if r[0] is None else r[0], (r[1] or "")) for r in corpus}, key=lambda r: (r[0], signed(r[1])))
    seen, want = set(), {}
    for i, text in rows:
        b, covered = text.encode(), set()
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                covered.update(range(p, p + 100))
            else:
                seen.add(b[p : p + 100])
        spans = sum(p in covered and p - 1 not in covered for p in range(len(b)))
        want[i, text] = (len(b), len(covered), spans, sha(bytes(x for p, x in enumerate(b) if p not in covered)))
    have = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in suffix_dedup.remove_repeats(docs).collect())
    assert have == Counter((r[0], *want[LOW if r[0] is None else r[0], r[1] or ""]) for r in corpus)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def test_suffix_dedup_of_crowded_names(docs, monkeypatch):
    """Names with many contexts take Spark's sort of windows and give the same bytes."""
    key = lambda df: Counter((r.doc_id, r.n_removed, sha(bytes(r.kept))) for r in df.collect())
    want = key(suffix_dedup.remove_repeats(docs))
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 2)
    assert key(suffix_dedup.remove_repeats(docs)) == want


def test_packing(docs, corpus, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in corpus:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), 4096):
            part = np.array(ids[p : p + 4096], "<u4")
            want[r[0], p // 4096, p, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.packed_documents(docs, tokenizer_path()).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(filled) <= -(-total // 4096) + 1
    ids = packing.sequences(docs.limit(9), tokenizer_path())
    assert ids.select(F.sum(F.size("ids"))).first()[0] == packing.pieces(docs.limit(9), tokenizer_path()).agg(F.sum("length")).first()[0]
    assert packing.packed_documents(empty, tokenizer_path()).count() == 0


def test_packing_plan():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 400):
        lengths = Counter(int(x) for x in rng.integers(1, 65, n))
        got, used = Counter(), defaultdict(list)
        for length, first, count, sequence, per, offset in packing.plan(lengths, 64):
            assert first == got[length]
            got[length] += count
            for j in range(count):
                used[sequence + j // per].append((offset + j % per * length, length))
        assert got == lengths
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 64
            assert sum(3 * length > 64 for _, length in parts) <= 2


def brute_fingerprint(t):
    w = WORD.findall(lower(t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_dup(docs, corpus, empty):
    got = near_dup.near_duplicates(docs).withColumn("hex", hex16(F.col("fp"))).collect()
    fps = [brute_fingerprint(r[1] or "") for r in corpus]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and find(i) != find(j):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(corpus):
        root = find(i)
        least[root] = min(least.get(root, 2**63), LOW if r[0] is None else r[0])
    real = lambda i: None if i == LOW else i
    want = Counter((r[0], f"{fps[i]:016x}", real(least[find(i)])) for i, r in enumerate(corpus))
    assert Counter((r.doc_id, r.hex, r.component_id) for r in got) == want
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({find(i) for i in range(len(fps))})
    assert near_dup.near_duplicates(empty).count() == 0 and near_dup.one_of_each(empty).count() == 0


def planted(rng, n, centres=5, flips=5):
    fps = set()
    while len(fps) < n:
        x = int(rng.integers(-(2**63), 2**63)) if len(fps) < centres else int(rng.choice(list(fps)[:centres]))
        for b in rng.choice(63, rng.integers(0, flips), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    return fps


def brute_roots(fps, radius=3):
    fps = np.array(sorted(fps))
    root = np.arange(len(fps))
    for i, x in enumerate(fps):
        near = np.flatnonzero(np.bitwise_count((fps ^ x).view(np.uint64)) <= radius)
        for r in set(root[near]):
            root[root == r] = min(root[near].min(), r)
        root[np.isin(root, root[near])] = root[near].min()
    return {(int(f), int(fps[r])) for f, r in zip(fps, root) if fps[r] != f}


def test_near_dup_with_longer_keys(spark, monkeypatch):
    """Lists posted under longer keys connect what brute force connects."""
    fps = planted(np.random.default_rng(11), 700)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = brute_roots(fps)
    groups = lambda: {(r.node, r.root) for r in near_dup.components(near_dup.links(df)).collect()}
    assert groups() == want and want
    assert near_dup.links(df).count() < 700 * 8
    for most in (64, 2):
        monkeypatch.setattr(near_dup, "LIST", most)
        assert groups() == want


def test_near_dup_of_a_hot_list(spark, monkeypatch):
    """Thousands of fingerprints that share five bytes and more, far over the length of a list."""
    monkeypatch.setattr(near_dup, "LIST", 64)
    rng = np.random.default_rng(5)
    low = np.unique(rng.choice(1 << 17, 8_000, replace=False))
    fps = low | (0x1234567 << 24)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long").repartition(4)
    got = {r.node: r.root for r in near_dup.components(near_dup.links(df)).collect()}
    # brute force: every fingerprint's neighbours by flipping up to three of the 24 bits
    here = np.zeros(1 << 17, bool)
    here[low] = True
    flips = [sum(1 << b for b in c) for k in (1, 2, 3) for c in combinations(range(17), k)]
    root = np.full(1 << 17, 1 << 17)
    root[low] = low
    for _ in range(64):
        before = root[low].copy()
        for f in flips:
            other = low ^ f
            near = here[other]
            root[low[near]] = np.minimum(root[low[near]], root[other[near]])
        root[low] = root[root[low]]
        if (root[low] == before).all():
            break
    base = 0x1234567 << 24
    assert {int(x) | base: got.get(int(x) | base, int(x) | base) for x in low} == {int(x) | base: int(root[x]) | base for x in low}


def test_tally_counts_shared_positions():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 3, (40, 8)).astype(np.uint8) for _ in range(2))
    got = near_dup.tally(a.view(np.uint64).ravel(), b.view(np.uint64).ravel())
    assert all(got[i, j] == sum(x == y for x, y in zip(a[i], b[j])) for i in range(40) for j in range(40))


def test_keys_meet_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    for radius in (1, 2, 3):
        levels = near_dup.key_masks(radius)
        for _ in range(300):
            flips = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            now = [0]
            for masks in levels:  # each level has a key that the pair shares, below any such key of the level before
                assert all(any(not k & flips for k in masks[m]) for m in now)
                now = [k for m in now for k in masks[m] if not k & flips]


def test_position_sets_hold_every_choice():
    for size in (1, 2, 3, 4, 5):
        sets = near_dup.position_sets(5, size)
        assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), 5)), size
