"""Benchmark decontamination: an FM-index for each shard of the documents, searched backwards for test phrases.

A task reads its documents once and writes an index for every ``SHARD_WORDS`` words: the last
column of the sorted suffixes as a wavelet matrix, and the places of every eighth suffix. The
index is a table in the shared folder, so any number of benchmarks is screened without reading
the texts again. Phrases of all benchmark items pass over the shards in blocks of a fixed size;
in a shard, each phrase is narrowed word by word from its end, the rows that are left are
located, and the words that they cover are merged to spans.

What holds for all functions here:

* Nulls: a null text has no words; a null id stays null; an item of null id counts as the item ``''``.
* Items of fewer words than the window are one phrase, items without words none. Items of equal
  id count as one. Repeated rows are documents of their own.
* Empty tables give empty results, or documents without hits.
* Extra columns are not read by :func:`build_index` and :func:`screen`; :func:`without_passages` keeps them, whatever their names.
* Very long texts: a text is never split, so a shard holds ``SHARD_WORDS`` words or its longest
  text; a task needs about 150 bytes a word of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialise
from .fm_index import FIELDS, ROWS, FmIndex
from .words import byte_class, coded, split_words

WINDOW = 10
SHARD_WORDS = 1_000_000
#: Phrases that are broadcast together, and the bytes of their words: a block ends at either.
BLOCK_PHRASES, BLOCK_BYTES = 200_000, 1 << 24

#: Letters, digits and all that is not ASCII.
_WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_SPANS = "spans array<struct<start: int, stop: int>>"


def _packed_words(dictionary: pa.Array) -> tuple[bytes, bytes]:
    ends = np.frombuffer(dictionary.buffers()[1], np.int32, len(dictionary) + 1, dictionary.offset * 4)
    data = dictionary.buffers()[2]
    return (data.to_pybytes()[ends[0] : ends[-1]] if data is not None else b""), (ends - ends[0]).astype("<i4").tobytes()


def _unpacked_words(letters: bytes, ends: bytes) -> pa.Array:
    return pa.StringArray.from_buffers(len(ends) // 4 - 1, pa.py_buffer(ends), pa.py_buffer(letters))


def build_index(docs: DataFrame, id_column: str = "doc_id", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The table of FM-indexes of ``docs`` (``id_column``, ``text``), one row a shard.

    ``ids``, ``keys`` (hashes of the texts) and ``n_words`` tell the shard's documents in order.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    text = F.col("text").cast("string")
    schema = f"shard string, ids array<{kind}>, keys array<string>, n_words array<bigint>, letters binary, ends binary, " + ", ".join(f"{f} binary" for f in FIELDS)

    def shard(name: str, ids: list, keys: list, words: list, sizes: list) -> pa.RecordBatch:
        codes, dictionary = coded(words)
        counts = np.concatenate(sizes)
        held = FmIndex.build(codes, counts, len(dictionary)).to_bytes()
        letters, ends = _packed_words(dictionary)
        row = lambda parts: pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.concat_arrays(parts))
        columns = [pa.array([name]), row(ids), row(keys), row([pa.array(counts, pa.int64())])]
        columns += [pa.array([b], pa.binary()) for b in (letters, ends, *(held[f] for f in FIELDS))]
        return pa.RecordBatch.from_arrays(columns, ["shard", "ids", "keys", "n_words", "letters", "ends", *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids, keys, words, sizes, held = [], [], [], [], 0
        for batch in batches:
            for first, found in split_words(batch.column(2), _WORD):
                upto, done = np.cumsum(found.counts), 0
                while done < len(found.counts):
                    # as many rows as fill the shard
                    taken = int(upto[done - 1]) if done else 0
                    to = min(len(upto), int(np.searchsorted(upto, taken + shard_words - held)) + 1)
                    ids.append(batch.column(0).slice(first + done, to - done))
                    keys.append(batch.column(1).slice(first + done, to - done))
                    words.append(found.text.slice(taken, int(upto[to - 1]) - taken))
                    sizes.append(found.counts[done:to])
                    held += int(upto[to - 1]) - taken
                    done = to
                    if held >= shard_words:
                        yield shard(f"{task}-{made}", ids, keys, words, sizes)
                        made += 1
                        ids, keys, words, sizes, held = [], [], [], [], 0
        if ids:
            yield shard(f"{task}-{made}", ids, keys, words, sizes)

    source = docs.select(F.col(id_column).alias("id"), F.md5(F.coalesce(text, F.lit(""))).alias("key"), text.alias("text"))
    # rows are megabytes: the writer looks at its memory after each
    return materialise(source.mapInArrow(run, schema), "fm-index", parquet_page_size_row_check_min=1, parquet_page_size_row_check_max=1, parquet_block_size=1 << 24)


def phrase_blocks(items: DataFrame, id_column: str = "item_id", window: int = WINDOW, block: int = BLOCK_PHRASES) -> Iterator[dict]:
    """The distinct phrases of benchmark items in blocks of a bounded size, with the items that hold each.

    A phrase is a run of ``window`` words of an item's ``text``, or a shorter item as a whole.
    """
    rows = items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))

    def closed(known: dict, phrases: dict) -> dict:
        table = np.full((len(phrases), window), -1, np.int32)
        for i, p in enumerate(phrases):
            table[i, : len(p)] = p
        owners = [sorted(o) for o in phrases.values()]
        names = sorted({o for own in owners for o in own})
        number = {o: i for i, o in enumerate(names)}
        first = np.concatenate([[0], np.cumsum([len(o) for o in owners])])
        return {
            "words": list(known), "phrases": table, "sizes": np.array([len(p) for p in phrases], np.int64),
            "names": names, "first": first, "owners": np.array([number[o] for own in owners for o in own], np.int64),
        }

    known: dict[str, int] = {}
    phrases: dict[tuple, set] = {}
    size = 0
    for row in rows.toLocalIterator():
        words = [w for _, found in split_words(pa.array([row.text], pa.string()), _WORD) for w in found.text.to_pylist()]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            own = words[i : i + window]
            size += sum(len(w.encode()) for w in own if w not in known)
            phrases.setdefault(tuple(known.setdefault(w, len(known)) for w in own), set()).add(row.id)
            if len(phrases) >= block or size >= BLOCK_BYTES:
                yield closed(known, phrases)
                known, phrases, size = {}, {}, 0
    if phrases:
        yield closed(known, phrases)


def _lists(by: np.ndarray, values: pa.Array, docs: np.ndarray) -> pa.Array:
    """``values`` (sorted by their document ``by``) as one list for each of ``docs``."""
    return pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(by, docs), len(by)), pa.int32()), values)


def _found(index: FmIndex, dictionary: pa.Array, sizes: np.ndarray, block: dict) -> tuple | None:
    """Documents of a shard that hold phrases, with their spans and items."""
    number = pc.index_in(pa.array(block["words"], pa.string()), value_set=dictionary)
    code = number.fill_null(-1).to_numpy(zero_copy_only=False)
    phrases = np.where(block["phrases"] >= 0, code[block["phrases"]], -1)
    lo, hi = index.search(phrases, block["sizes"])
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return None
    upto = np.cumsum((hi - lo)[hit])
    n, count = int(index.counts.sum()), len(phrases)
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    depth, pairs = np.zeros(n + 1, np.int32), []
    for s in range(0, int(upto[-1]), ROWS):
        at = np.arange(s, min(s + ROWS, int(upto[-1])))
        which = np.searchsorted(upto, at, side="right")
        phrase = hit[which]
        places = index.locate(hi[phrase] - upto[which] + at)
        depth += np.bincount(places, minlength=n + 1).astype(np.int32)
        depth -= np.bincount(places + block["sizes"][phrase], minlength=n + 1).astype(np.int32)
        pairs.append(np.unique((np.searchsorted(first, places, side="right") - 1) * count + phrase))
    covered = np.concatenate([[0], (np.cumsum(depth) > 0).astype(np.int8)])
    edges = np.diff(covered)
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    of = np.searchsorted(first, starts, side="right") - 1
    docs = np.unique(of)
    spans = pa.StructArray.from_arrays([pa.array(starts - first[of], pa.int32()), pa.array(stops - first[of], pa.int32())], ["start", "stop"])
    # a phrase stands for all items that hold it
    pair = np.unique(np.concatenate(pairs))
    phrase = pair % count
    many = np.diff(block["first"])[phrase]
    item = block["owners"][np.repeat(block["first"][phrase], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    held = np.unique(np.repeat(pair // count, many) * len(block["names"]) + item)
    names = pa.array(block["names"], pa.string()).take(pa.array(held % len(block["names"])))
    return docs, _lists(of, spans, docs), _lists(held // len(block["names"]), names, docs)


def _search(index: DataFrame, block: dict) -> DataFrame:
    """``shard, place, spans, items`` of the documents that hold phrases of the block."""
    held = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                arrays = FmIndex.from_bytes({f: row[f].as_buffer() for f in FIELDS})
                sizes = row["n_words"].values.to_numpy()
                found = _found(arrays, _unpacked_words(row["letters"].as_buffer(), row["ends"].as_buffer()), sizes, held.value)
                if found:
                    docs, spans, items = found
                    shard = pa.array([row["shard"].as_py()] * len(docs))
                    yield pa.RecordBatch.from_arrays([shard, pa.array(docs, pa.int32()), spans, items], ["shard", "place", "spans", "items"])

    hits = materialise(index.drop("ids", "keys").mapInArrow(run, f"shard string, place int, {_SPANS}, items array<string>"), "fm-hits")
    held.destroy()
    return hits


def _merged(hits: DataFrame) -> DataFrame:
    """One row per document of spans that neither meet nor overlap, and its items in order."""
    own = W.partitionBy("shard", "place").orderBy("start", "stop")
    reach = F.max("stop").over(own.rowsBetween(W.unboundedPreceding, -1))
    each = hits.select("shard", "place", F.explode("spans").alias("s")).select("shard", "place", "s.start", "s.stop").distinct()
    runs = each.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(own))
    spans = runs.groupBy("shard", "place", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = spans.groupBy("shard", "place").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    items = hits.groupBy("shard", "place").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return spans.join(items, ["shard", "place"])


def screen_index(index: DataFrame, items: DataFrame, id_column: str = "item_id", window: int = WINDOW, block: int = BLOCK_PHRASES) -> DataFrame:
    """``id, key, n_words, spans, items`` of every document of an index: the word spans that phrases of items cover.

    ``start`` counts words from 0, ``stop`` is the word after the span; ``items`` are sorted as strings.
    ``block`` is the most phrases that are broadcast together.
    """
    docs = index.select("shard", F.posexplode(F.arrays_zip("ids", "keys", "n_words")).alias("place", "d"))
    docs = docs.select("shard", "place", F.col("d.ids").alias("id"), F.col("d.keys").alias("key"), F.col("d.n_words").alias("n_words"))
    hits = None
    for phrases in phrase_blocks(items, id_column, window, block):
        more = _search(index, phrases)
        hits = more if hits is None else hits.unionByName(more)
    if hits is None:
        none = lambda kind: F.array().cast(kind)
        return docs.select("id", "key", "n_words", none("array<struct<start: int, stop: int>>").alias("spans"), none("array<string>").alias("items"))
    met = docs.join(_merged(hits), ["shard", "place"], "left")
    empty = lambda c: F.coalesce(c, F.array().cast(met.schema[c].dataType)).alias(c)
    return met.select("id", "key", "n_words", empty("spans"), empty("items"))


def screen(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As :func:`screen_index` over a new index of ``docs``; the id is ``doc_id``."""
    return screen_index(build_index(docs), items).withColumnRenamed("id", "doc_id")


def words_in(spans) -> F.Column:
    """The number of words in an array of spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def without_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with the bytes from the first to the last word of each hit span taken out of ``text``.

    All rows and columns stay; a null text stays null. Rows of one id are told apart by their texts.
    """
    hits = screen(docs, items).where(F.size("spans") > 0).dropDuplicates(["doc_id", "key"])
    own, key, spans = fresh(docs, "hit_id", "hit_key", "hit_spans")
    hits = hits.select(F.col("doc_id").alias(own), F.col("key").alias(key), F.col("spans").alias(spans))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for text, runs in zip(texts, cuts):
            if text is None or runs is None:
                out.append(None)
                continue
            raw, kept, at = text.encode(), [], 0
            _, words = next(iter(split_words(pa.array([text], pa.string()), _WORD)))
            for run in runs:
                kept.append(raw[at : words.start[run["start"]]])
                at = int(words.end[run["stop"] - 1])
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pd.Series(out, dtype=object)

    met = docs.join(hits, docs["doc_id"].eqNullSafe(hits[own]) & (F.md5(F.coalesce(docs["text"], F.lit(""))) == hits[key]), "left")
    text = F.when(F.col(spans).isNull(), docs["text"]).otherwise(cut(F.when(F.col(spans).isNotNull(), docs["text"]), F.col(spans)))
    return met.withColumn("text", text).drop(own, key, spans)
