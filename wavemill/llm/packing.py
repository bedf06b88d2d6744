"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Which piece goes where depends on lengths alone, and there are at most ``capacity`` of them.
So the pieces are counted by length (partial sums), the packing is planned over that
histogram, and each piece then finds its place by its rank among the pieces of its length.
Ranks come from distributed prefix sums; neither the driver nor a task sees all pieces.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

CAPACITY = 4096
#: Added after each document's ids.
END_ID = 1
#: Pieces of one length are ranked in buckets of about so many rows.
ROWS_PER_BUCKET = 20_000
#: Bytes of text that are split into words at once, and words remembered by a task.
SLICE_BYTES, MEMORY_WORDS = 2 << 20, 300_000
#: Words that the tokeniser gets as one string, and strings in one call. Its results are large
#: objects until they are read. The words are set apart by a string with an id of its own.
STRING_WORDS, CALL_STRINGS = 50, 200
APART = "<|startoftext|>"
#: Marks that follow a letter or number at a word's end are tokenised by themselves. Only letters
#: that stay single letters in lower case and normal form are listed (U+0130 does not).
END_MARKS = r"([A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}])([.,!?;:|*%$&#]+)( |\n|$)"
#: Texts with strings like these are tokenised whole: they are cased and may be ids of their own.
SPECIAL = r"(?i)<\|(start|end)oftext\|>"


class _Words:
    """Ids of words by tokeniser, remembered up to a bound.

    The tokeniser lower-cases, drops white space and never merges across it or between
    letters and marks, so a text's ids are those of its words and end marks in order.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.apart = self.tokenizer.token_to_id(APART)
        self.at: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.slices = np.zeros(1 << 14, np.int32)
        self.used = 0

    def _forget(self) -> None:
        """Forgets the words that only one slice of text had; if those are few, all."""
        seen = self.slices[: len(self.at)]
        keep = np.flatnonzero(seen > 1)
        if 2 * len(keep) > MEMORY_WORDS:
            keep = keep[:0]
        words = list(self.at)
        flat, ends = self._gather(keep)
        self.at = {words[i]: k for k, i in enumerate(keep)}
        self.pool, self.used = flat.copy(), len(flat)
        self.sizes, self.slices = self.sizes[keep], np.ones(len(keep), np.int32)
        self.starts = ends - self.sizes

    def _add(self, words: list[str]) -> None:
        strings = [APART.join([*words[i : i + STRING_WORDS], ""]) for i in range(0, len(words), STRING_WORDS)]
        found = []
        for i in range(0, len(strings), CALL_STRINGS):
            some = self.tokenizer.encode_batch_fast(strings[i : i + CALL_STRINGS], add_special_tokens=False)
            found += [np.array(e.ids, np.uint32) for e in some]
        ids = np.concatenate(found)
        ends = np.flatnonzero(ids == self.apart)
        self._store(words, ids[ids != self.apart], np.diff(ends, prepend=-1) - 1)

    def _store(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        n, end = len(self.at), self.used + len(flat)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(end, 1 << 16) // 2 + end - len(self.pool), np.uint32)])
        if n + len(sizes) > len(self.starts):
            more = np.zeros(n + len(sizes) - len(self.starts) + (1 << 14), np.int64)
            self.starts, self.sizes = np.concatenate([self.starts, more]), np.concatenate([self.sizes, more])
            self.slices = np.concatenate([self.slices, more.astype(np.int32)])
        self.pool[self.used : end] = flat
        self.sizes[n : n + len(sizes)] = sizes
        self.starts[n : n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.at.update(zip(words, range(n, n + len(sizes))))
        self.used = end

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of coded words, and where each word's end."""
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.starts[codes] - ends + sizes, sizes) + np.arange(total)], ends

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
        """All ids of the texts, where each text's end, and the ids of special texts (which have none there)."""
        special = pc.match_substring_regex(texts, SPECIAL)
        whole = {}
        if pc.any(special).as_py():
            at = np.flatnonzero(special.to_numpy(zero_copy_only=False))
            whole = {int(i): self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids for i in at}
            texts = pc.if_else(special, "", texts)
        apart = pc.replace_substring_regex(pc.ascii_lower(texts), END_MARKS, r"\1 \2\3")
        lists = pc.split_pattern(pc.replace_substring(apart, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.at) + len(words) > MEMORY_WORDS:
            self._forget()
        if new := [w for w in words if w not in self.at]:
            self._add(new)
        at = self.at
        own = np.fromiter((at[w] for w in words), np.int64, len(words))
        self.slices[own] += 1
        codes = own[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        out, ends = self._gather(codes)
        bounds = np.asarray(lists.offsets)
        return out, np.concatenate([[0], ends])[bounds[1:] - bounds[0]], whole


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The vocabulary, whose size is fixed; a worker keeps it from task to task, and nothing else."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_BYTES)))
        yield a, b
        a = b


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every document.

    Documents longer than ``capacity`` ids are cut into full pieces and a rest. A null text is
    empty and gives the end id alone.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(_tokenizer(path))
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for a, b in _slices(texts):
                ids, ends, whole = words.ids(texts.slice(a, b - a))
                rows, parts, begun, lengths, crcs, kept = [], [], [], [], [], []
                s = 0
                for r, e in enumerate(ends):
                    own = np.append(np.array(whole[r], np.uint32) if r in whole else ids[s:e], np.uint32(END_ID))
                    s = e
                    for p in range(0, len(own), capacity):
                        part = own[p : p + capacity]
                        rows.append(a + r)
                        parts.append(p // capacity)
                        begun.append(p)
                        lengths.append(len(part))
                        crcs.append(zlib.crc32(part.astype("<u4").tobytes()))
                        if with_ids:
                            kept.append(part.astype(np.int32))
                columns = [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(parts, pa.int32()),
                    pa.array(begun, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        pa.default_memory_pool().release_unused()  # the worker lives on with other stages

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``histogram[length]`` pieces of each length, as runs.

    A run ``(length, first_rank, n, first_sequence, per_sequence, offset)`` says: the pieces of
    this length with ranks from ``first_rank`` on go ``per_sequence`` to a sequence, from
    ``first_sequence`` on, side by side from ``offset``.

    Lengths over a third of the capacity meet in pairs, the longest first with the longest
    partner that fits. The others, longest first, go where the least room is left that holds
    them. The work and the number of runs depend on the distinct lengths, not on the pieces.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    room: list[tuple[int, int, int]] = []  # (free, first sequence, sequences), sorted
    sequences = 0

    def put(length: int, n: int, first: int, per: int, offset: int) -> None:
        runs.append((length, rank[length], n, first, per, offset))
        rank[length] += n
        left[length] -= n

    def free(space: int, first: int, n: int) -> None:
        if space and n:
            insort(room, (space, first, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        i = bisect_left(large, capacity - a + 1) - 1
        if i >= 0 and large[i] == a and left[a] == 1:
            i -= 1
        if i < 0:
            n = left[a]
            put(a, n, sequences, 1, 0)
            free(capacity - a, sequences, n)
        elif large[i] == a:
            n = left[a] // 2
            put(a, 2 * n, sequences, 2, 0)
            free(capacity - 2 * a, sequences, n)
        else:
            b = large[i]
            n = min(left[a], left[b])
            put(a, n, sequences, 1, 0)
            put(b, n, sequences, 1, a)
            free(capacity - a - b, sequences, n)
        sequences += n
        large = [x for x in large if left[x]] if not left[a] or (i >= 0 and not left[large[i]]) else large
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            i = bisect_left(room, (length, -1, -1))
            if i < len(room):
                space, first, n = room.pop(i)
            else:
                per = capacity // length
                space, first, n = capacity, sequences, -(-left[length] // per)
                sequences += n
            per = space // length
            whole = min(n, left[length] // per)
            if whole:
                put(length, whole * per, first, per, capacity - space)
                free(space - per * length, first, whole)
            if whole < n:
                rest = left[length]
                if rest:
                    put(length, rest, first + whole, rest, capacity - space)
                    free(space - rest * length, first + whole, 1)
                    whole += 1
                free(space, first + whole, n - whole)
    return runs


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id, offset`` (long) to rows with ``doc_id, piece, length, ids_crc32``.

    Rows are ranked among those of their length by a hash of id and piece; equal rows are
    interchangeable. An empty table gives no rows.
    """
    spark = cut.sparkSession
    cut = materialise(cut, "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.createDataFrame(
        plan(histogram, capacity) or [(0, 0, 0, 0, 1, 0)],
        "r_length long, first_rank long, n long, first_sequence long, per long, first_offset long",
    )
    buckets = max(16, -(-sum(histogram.values()) // ROWS_PER_BUCKET))
    spread = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    along = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        spread.groupBy("length", "bucket")
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("base", F.coalesce(F.sum("c").over(along), F.lit(0)))
        .select(F.col("length").alias("b_length"), F.col("bucket").alias("b_bucket"), "base")
    )
    within = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        spread.withColumn("rank", F.row_number().over(within) - 1)
        .join(bases, (F.col("length") == F.col("b_length")) & (F.col("bucket") == F.col("b_bucket")))
        .withColumn("rank", F.col("rank") + F.col("base"))
    )
    inside = (
        (F.col("length") == F.col("r_length"))
        & (F.col("rank") >= F.col("first_rank"))
        & (F.col("rank") < F.col("first_rank") + F.col("n"))
    )
    nth = F.col("rank") - F.col("first_rank")
    return (
        ranked.join(F.broadcast(runs), inside)
        .withColumn("sequence_id", F.col("first_sequence") + F.expr("(rank - first_rank) div per"))
        .withColumn("offset", (F.col("first_offset") + nth % F.col("per") * F.col("length")).cast("long"))
        .select(*cut.columns, "sequence_id", "offset")
    )


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece of the end id alone. A null id stays null, and rows with one
    are packed like others. Repeated rows are packed each for themselves, in places of their
    own; which of them gets which is open, as is which of the pieces of one length comes first
    among equal hashes. A text is tokenised whole by one task, however long, and needs memory in
    proportion to its length there. An empty table gives no rows. Other columns of ``docs`` than
    ``doc_id`` and ``text`` are not read.
    """
    return pack(pieces(docs, path, capacity), capacity)


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, ids``: each packed sequence's ids in order. A sequence holds ``capacity`` ids at most."""
    packed = pack(pieces(docs, path, capacity, with_ids=True), capacity)
    return packed.groupBy("sequence_id").agg(
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
        ).alias("ids")
    )
