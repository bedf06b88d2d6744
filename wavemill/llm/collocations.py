"""Phrase collocations by contiguous pattern growth: occurrence pointers of a frequent prefix, extended to the right depth-first.

Every word of a piece begins a window of up to ``LONGEST`` words. Windows are dealt out by
their prefix, so that one task holds all occurrences of a prefix and grows it alone: it keeps
pointers into its windows, sorts those of a prefix by their next word, and goes on with each
frequent extension before it turns to the next. A first word that is too frequent for a task is
dealt out by its second word as well, and a pair of words that still is by its third; only the
counts of such prefixes are partial in a task and are summed afterwards.

Windows travel as packed blocks (codes of two or four bytes and the words they stand for), after
equal windows of a map task have become one with a count. Nothing depends on a dictionary of the
corpus, on sampling or on hashes being distinct: hashes only say where a window goes.

What holds for all functions here:

* Nulls: a null text is empty; a null language is ``und``, together with a language of that name.
  Ids and other columns are not read, so their nulls, repeats and names do not matter.
* Repeated rows count as often as they come. Equal scores rank by the phrase's count and then by
  its UTF-8 bytes; of cuts that tie, the shortest first part counts.
* An empty table, or one without frequent phrases, gives an empty result.
* Very long texts are read in slices; a task holds the windows of ``FLUSH_WORDS`` words or of one
  slice, at about 120 bytes each.
* A task that grows prefixes holds about ``bucket`` windows at 40 bytes, or one of 2 ** 17 of the
  corpus where that is more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise
from .words import byte_class, coded, split_words

LEAST, LONGEST, BEST = 30, 4, 2000
FLUSH_WORDS = 1 << 20
#: Windows that a growing task is meant to hold, and the most tasks that the corpus is dealt over.
BUCKET, MOST_BUCKETS = 1 << 20, 1 << 17

_BREAKS = byte_class((0x0A, 0x0D), *[(ord(c), ord(c)) for c in ".,;:!?"])
_WORD = ~(_BREAKS | byte_class((0x20, 0x20), (0x09, 0x09)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Names of languages, the language and code of each word, whether a piece ends after it, and the words."""
    langs, words, breaks, sizes, held = [], [], [], [], 0

    def flushed():
        codes, dictionary = coded(words)
        lang, names = coded(langs)
        return names, np.repeat(lang, np.concatenate(sizes)), codes.astype(np.int64), np.concatenate(breaks), dictionary

    for batch in batches:
        for first, found in split_words(batch.column(1), _WORD, _BREAKS):
            langs.append(batch.column(0).slice(first, len(found.counts)))
            words.append(found.text)
            breaks.append(found.broken)
            sizes.append(found.counts)
            held += len(found.text)
            if held >= FLUSH_WORDS:
                yield flushed()
                langs, words, breaks, sizes, held = [], [], [], [], 0
    if held:
        yield flushed()


def _frequent_places(docs: DataFrame) -> DataFrame:
    """``lang, first, second, n``: words (``second`` null) and pairs that may be too frequent for a task; ``first`` null is the language's number of words.

    A task tells prefixes with one of 2 ** 17 of its words or more, so a prefix that is frequent
    in the corpus is missed only where it is rare. Counts place windows and are never results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, lang, codes, broken, words in _flushes(batches):
            least, many = max(1, len(codes) // MOST_BUCKETS), len(words)
            out = [(np.arange(len(names)), None, None, np.bincount(lang, minlength=len(names)))]
            key, n = np.unique(lang * many + codes, return_counts=True)
            key, n = key[n >= least], n[n >= least]
            out.append((key // many, key % many, None, n))
            goes = np.flatnonzero(~broken[:-1]) if len(codes) else np.zeros(0, int)
            often = np.zeros(len(names) * many, bool)
            often[key] = True
            goes = goes[often[lang[goes] * many + codes[goes]]]
            pair, n = np.unique((lang[goes] * many + codes[goes]) * many + codes[goes + 1], return_counts=True)
            pair, n = pair[n >= least], n[n >= least]
            out.append((pair // many // many, pair // many % many, pair % many, n))
            word = lambda c, n: pa.nulls(len(n), pa.string()) if c is None else words.take(pa.array(c))
            for where, a, b, n in out:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(where)), word(a, n), word(b, n), pa.array(n, pa.int64())], ["lang", "first", "second", "n"])

    rows = _texts(docs).mapInArrow(run, "lang string, first string, second string, n long")
    return materialise(rows.groupBy("lang", "first", "second").agg(F.sum("n").alias("n")), "phrase-places")


class _Plan:
    """Where windows go: tasks by language, and the prefixes that are dealt out further. Its size is bounded by ``MOST_BUCKETS``."""

    def __init__(self, places: DataFrame, bucket: int):
        self.totals = {r.lang: r.n for r in places.where("first is null").collect()}  # a row by language
        size = max(bucket, sum(self.totals.values()) // MOST_BUCKETS)
        self.tasks = {k: -(-n // size) for k, n in self.totals.items()}
        # counts sum to the words at most, so no more than 4 * MOST_BUCKETS prefixes pass
        often = places.where((F.col("n") > max(1, size // 2)) & F.col("first").isNotNull()).collect()
        self.words: dict[str, list[str]] = {}
        self.pairs: dict[str, list[tuple[str, str]]] = {}
        for r in often:
            if r.second is None:
                self.words.setdefault(r.lang, []).append(r.first)
        hot = {k: set(v) for k, v in self.words.items()}
        for r in often:
            if r.second is not None and r.first in hot.get(r.lang, ()):
                self.pairs.setdefault(r.lang, []).append((r.first, r.second))

    def flags(self, lang: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which codes of ``words`` are split, and the split pairs as sorted ``first * len(words) + second``."""
        split = np.zeros(len(words), bool)
        at = pc.index_in(pa.array(self.words.get(lang, []), pa.string()), value_set=words).drop_null().to_numpy(zero_copy_only=False)
        split[at.astype(np.int64)] = True
        pairs = self.pairs.get(lang, [])
        code = lambda k: pc.index_in(pa.array([p[k] for p in pairs], pa.string()), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        a, b = code(0), code(1)
        known = (a >= 0) & (b >= 0)
        return split, np.sort(a[known] * len(words) + b[known])


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, values), max(len(ordered) - 1, 0))
    return ordered[at] == values if len(ordered) else np.zeros(len(values), bool)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _windows(codes: np.ndarray, broken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of up to four codes (from 1; 0 is no word) and how often each comes."""
    n = len(codes)
    after = np.zeros(n + 3, np.int64)
    after[:n] = codes + 1
    ends = np.ones(n + 3, bool)
    ends[:n] = broken
    second = np.where(ends[:n], 0, after[1 : n + 1])
    # a window is the pair at its place and, where the piece goes on, the pair two words later
    wide = int(codes.max()) + 2
    pair, of = np.unique(after[:n] * wide + second, return_inverse=True)
    later = np.zeros(n + 2, np.int64)
    later[:n] = of + 1
    key = of * (len(pair) + 1) + np.where(ends[:n] | ends[1 : n + 1], 0, later[2 : n + 2])
    key, times = np.unique(key, return_counts=True)
    low, high = pair[key // (len(pair) + 1)], np.concatenate([[0], pair])[key % (len(pair) + 1)]
    return np.stack([low // wide, low % wide, high // wide, high % wide], axis=1), times


_BLOCK = "lang string, bucket int, letters binary, ends binary, codes binary, times binary"


def _project(docs: DataFrame, plan) -> DataFrame:
    """Blocks of windows by ``lang, bucket``: the projection of every first word, or longer prefix, to its task."""

    def blocks(name: str, windows: np.ndarray, times: np.ndarray, words: pa.Array) -> Iterator[tuple]:
        tasks = plan.value.tasks[name]
        hashes = np.concatenate([[0], [xxhash.xxh64_intdigest(w) for w in words.to_pylist()]]).astype(np.uint64)
        split, pairs = plan.value.flags(name, words)
        a, b, c = (windows[:, k] for k in range(3))
        where = _mixed(hashes[a], np.uint64(1))
        deep = np.flatnonzero(split[a - 1])
        where[deep] = _mixed(where[deep], hashes[b[deep]])
        deep = deep[(b[deep] > 0) & _within((a[deep] - 1) * len(words) + b[deep] - 1, pairs)]
        where[deep] = _mixed(where[deep], hashes[c[deep]])
        where = (where % np.uint64(tasks)).astype(np.int64)
        by = np.argsort(where, kind="stable")
        where, windows, times = where[by], windows[by], times[by]
        heads = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        for s, e in zip(heads, np.append(heads[1:], len(where))):
            used, codes = np.unique(windows[s:e], return_inverse=True)
            if used[0] != 0:
                used, codes = np.concatenate([[0], used]), codes + 1
            own = words.take(pa.array(used[1:] - 1))
            ends = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1)
            kind = "<u2" if len(used) <= 0xFFFF else "<u4"
            yield int(where[s]), own.buffers()[2].to_pybytes()[: ends[-1]], ends.tobytes(), codes.astype(kind).tobytes(), times[s:e].astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, lang, codes, broken, words in _flushes(batches):
            for k, name in enumerate(names.to_pylist()):
                own = np.flatnonzero(lang == k)
                if not len(own):
                    continue
                # words of other languages lie in other rows, after which pieces are broken
                windows, times = _windows(codes[own], broken[own])
                for bucket, letters, ends, packed, n in blocks(name, windows, times, words):
                    columns = [pa.array([name]), pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in (letters, ends, packed, n))]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "letters", "ends", "codes", "times"])

    return _texts(docs).mapInArrow(run, _BLOCK)


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The windows of all blocks of a task with codes of one dictionary (from 1), their counts, and the words."""
    texts, sizes, windows, times = [], [], [], []
    for letters, ends, codes, n in zip(*(table[c] for c in ("letters", "ends", "codes", "times"))):
        count = len(ends.as_buffer()) // 4 - 1
        texts.append(pa.StringArray.from_buffers(count, ends.as_buffer(), letters.as_buffer()))
        times.append(np.frombuffer(n.as_buffer(), "<u4").astype(np.int64))
        raw = codes.as_buffer()
        windows.append(np.frombuffer(raw, "<u2" if len(raw) == 8 * len(times[-1]) else "<u4").reshape(-1, LONGEST))
        sizes.append(count)
    code, words = coded(texts)
    first = np.cumsum(sizes) - sizes
    for i, (w, at, size) in enumerate(zip(windows, first, sizes)):
        windows[i] = np.concatenate([[0], code[at : at + size] + 1]).astype(np.int32)[w]
    return np.concatenate(windows), np.concatenate(times), words


def grow(windows: np.ndarray, times: np.ndarray, split: np.ndarray, pairs: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Frequent prefixes (codes from 1) of windows with their counts; those that are dealt over tasks come whatever their count.

    ``split`` tells the first words (by code from 0) and ``pairs`` the first pairs whose counts are partial.
    """
    many = len(split)

    def extended(prefix: tuple[int, ...], pointers: np.ndarray) -> Iterator[tuple[tuple[int, ...], int]]:
        depth = len(prefix)
        follow = windows[pointers, depth]
        if depth:
            going = follow > 0
            pointers, follow = pointers[going], follow[going]
        if not len(pointers):
            return
        by = np.argsort(follow, kind="stable")
        pointers, follow = pointers[by], follow[by]
        heads = np.flatnonzero(np.concatenate([[True], follow[1:] != follow[:-1]]))
        sums, nexts = np.add.reduceat(times[pointers], heads), follow[heads]
        partial = np.zeros(len(heads), bool)
        if depth == 0:
            partial = split[nexts - 1]
        elif depth == 1 and split[prefix[0] - 1]:
            partial = _within((prefix[0] - 1) * many + nexts.astype(np.int64) - 1, pairs)
        stops = np.append(heads[1:], len(pointers))
        for g in np.flatnonzero((sums >= least) | partial):
            longer = (*prefix, int(nexts[g]))
            yield longer, int(sums[g])
            if depth + 1 < LONGEST:
                yield from extended(longer, pointers[heads[g] : stops[g]])

    yield from extended((), np.arange(len(windows)))


def frequent_phrases(docs: DataFrame, least: int = LEAST, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """``lang, words, phrase, f`` of all phrases of one to four words that come ``least`` times in a language, and ``lang, n``."""
    spark = docs.sparkSession
    places = _frequent_places(docs)
    plan = spark.sparkContext.broadcast(_Plan(places, bucket))

    def task(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        windows, times, words = _gathered(table)
        split, pairs = plan.value.flags(lang, words)
        own = words.to_pylist()
        phrases, sizes, counts = [], [], []
        for prefix, f in grow(windows, times, split, pairs, least):
            phrases.append(" ".join(own[c - 1] for c in prefix))
            sizes.append(len(prefix))
            counts.append(f)
        return pa.table({"lang": pa.array([lang] * len(sizes), pa.string()), "words": pa.array(sizes, pa.int32()), "phrase": pa.array(phrases, pa.string()), "f": pa.array(counts, pa.int64())})

    grown = _project(docs, plan).groupBy("lang", "bucket").applyInArrow(task, "lang string, words int, phrase string, f long")
    summed = grown.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    phrases = materialise(summed, "phrases")
    plan.destroy()
    return phrases, places.where("first is null").select("lang", "n")


def scored(phrases: DataFrame) -> DataFrame:
    """``lang, words, phrase, a, l, r, score`` of phrases of two words or more, by their weakest cut."""
    parts = F.split("phrase", " ")
    some = phrases.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), parts.alias("own"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    joined = lambda first, length: F.array_join(F.slice("own", first, length), " ")
    cuts = some.select("lang", "words", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    known = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(known.withColumnsRenamed({"phrase": "left", "f": "l"}), ["lang", "left"]).join(known.withColumnsRenamed({"phrase": "right", "f": "r"}), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", wide("a") * F.lit(2_000_000).cast("decimal(7,0)"), wide("l") + wide("r"))
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "words", "phrase", "a").agg(least).select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, bucket: int = BUCKET) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``best`` phrases of two to four words.

    A phrase goes where a longer one that holds it comes at least four times for each five of its own.
    """
    phrases, totals = frequent_phrases(docs, least, bucket)
    longer = phrases.where("words > 2").select("lang", F.split("phrase", " ").alias("own"), "words", "f")
    inner = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    held = inner.groupBy("lang", F.array_join(F.slice("own", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("f").alias("most"))
    # 100 * most >= 80 * a, without a product
    stays = F.col("most").isNull() | (F.col("most") < F.col("a") - F.floor(F.expr("a div 5")))
    kept = scored(phrases).join(held, ["lang", "phrase"], "left").where(stays)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = kept.select("lang", "phrase", "a", "l", "r", "score").withColumn("rank", rank).where(F.col("rank") <= best)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
