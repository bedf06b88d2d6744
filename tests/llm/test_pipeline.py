"""The pipeline's stages on odd rows, and its run on the smallest tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from test_operators import WORD, brute_fingerprint, lower
from tokenizers import Tokenizer

from wavemill.llm import queries, toxicity
from wavemill.llm.queries import tokenizer_path


def test_stages_pass_on_what_they_keep(spark, docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now, counts = docs, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
        path = str(tmp_path / f"stage-{k}")
        out.write.parquet(path)
        now = spark.read.parquet(path)
        counts.append(now.count())
    assert counts[1] == counts[0] == counts[2] > counts[3] > 0
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(now.columns)


def test_stages_on_an_empty_table(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def brute_lines(rows):
    """``rows`` (id, text, source) without the lines that three documents hold, but for the last holder."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t, _ in rows:
        for line in t.split("\n"):
            holders[key(line)].add(i)
    stays = lambda i, line: len(key(line)) < 20 or len(holders[key(line)]) < 3 or max(holders[key(line)]) == i
    return [(i, "\n".join(x for x in t.split("\n") if stays(i, x)), s) for i, t, s in rows]


def brute_one_of_each(rows):
    """The smallest id of each group that fingerprints at most three bits apart connect."""
    left = {i: brute_fingerprint(t) for i, t, _ in rows}
    kept = set()
    for i in sorted(left):
        if i in left:
            kept.add(i)
            group = [left.pop(i)]
            while group:
                f = group.pop()
                for j in [j for j, g in left.items() if (f ^ g).bit_count() <= 3]:
                    group.append(left.pop(j))
    return [r for r in rows if r[0] in kept]


def brute_mix(rows):
    """Copies of whole documents up to each source's budget, in order of their hashed ids."""
    by_source, words = defaultdict(list), {i: len(WORD.findall(t)) for i, t, _ in rows}
    for r in rows:
        by_source[r[2]].append(r)
    size = {s: sum(words[i] for i, _, _ in own) for s, own in by_source.items()}
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(size))}
    full = set()
    while True:
        level = (sum(size.values()) - 3 * sum(size[s] for s in full)) / sum(weight[s] for s in size if s not in full)
        more = {s for s in size if s not in full and level * weight[s] > 3 * size[s]}
        if not more:
            break
        full |= more
    out = []
    for s, own in by_source.items():
        budget = 3 * size[s] if s in full else math.floor(level * weight[s])
        epochs, left = divmod(budget, size[s])
        for i, t, _ in sorted(own, key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
            out += [(i, t)] * ((epochs + (left > 0)) if words[i] else 0)
            left -= words[i]
    return out


def test_run_against_brute_force(spark, tmp_path):
    """Every row of the run, stage by stage; only the verdicts on toxicity are the operator's own."""
    rng = random.Random(23)
    prose = lambda rng, n: " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(400)}" for _ in range(n))
    shared = "A line that the footers of several documents have in common."
    texts = [prose(rng, rng.randrange(20, 120)) for _ in range(60)]
    texts += [f"{prose(rng, 40)}\n{shared}\n{prose(rng, 9)}" for _ in range(6)]
    texts += [texts[3], texts[3], texts[7] + " end", "", " \n", prose(rng, 6_000)]
    base = prose(rng, 4_000).split()
    texts += [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(100, 4_000, 700)]
    bad = len(texts)
    texts += [f"{prose(rng, 30)} blorghead {prose(rng, 10)}" for _ in range(40)]
    rows = [(i, t, f"s{i * i % 5}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(i >= bad)) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    verdicts = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, labels).collect()}
    assert all(verdicts[i] == (i >= bad) for i, _, _ in rows)
    clean = [r for r in rows if not verdicts[r[0]]]
    lined = brute_lines(clean)
    assert sum(a != b for a, b in zip(clean, lined)) == 7
    single = brute_one_of_each(lined)
    assert len(single) < len(lined) - 6  # three texts without words besides near copies
    tokenizer, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for i, t in brute_mix(single):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            part = np.array(ids[p : p + 4096], "<u4")
            want[i, p // 4096, p, len(part), zlib.crc32(part.tobytes())] += 1

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert any(r.piece for r in got) and max(want.values()) > 1
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        ends = [0, *[a + n for a, n in sorted(parts)]]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    assert len(places) <= -(-sum(r.length for r in got) // 4096) + 1


@pytest.mark.parametrize("n", range(1, 11))
def test_one_query_for_each_operator(n):
    assert sum(q.startswith(f"op{n}_") for q in queries.queries()) == 1
