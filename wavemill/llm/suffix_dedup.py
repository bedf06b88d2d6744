"""Removal of repeated substrings by sorting sampled suffixes and inducing the rest.

This replaces external induced suffix sorting: suffixes are not put in lexical order, common
prefixes are not computed, and windows are compared by 64-bit hashes. That sorting every suffix
would move the corpus many times is an estimate; no attempt was measured. Here a sample of suffixes is sorted
and the others are induced from it, level by level:

1. *Seeds.* A suffix is sampled where the hash of its first ``SEED`` bytes is least among the
   windows of ``length`` bytes around it. Every window holds a seed and equal windows hold
   the same ones, so whatever repeats, repeats at seeds.
2. *First sort.* Suffix tuples (name of the first bytes, name of the context that all windows
   over the seed span, document, offset) are sorted by Spark's external merge sort, which
   spills to disk. Of equal contexts every one but the first is a repeat as a whole: its
   windows are induced without looking at them.
3. *Second sort.* Where one name has several contexts, prefixes in common end inside them. For
   the first suffix of each such context the bytes are fetched, and its windows are ordered
   by content within the name; again all but the first of equal ones are repeats.

Tuples that repeat within one batch are settled there, so a passage that many documents
share reaches the sort at most once per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, materialise

LENGTH = 100
#: Bytes that name a seed. More bytes make chance meetings rarer and seeds denser.
SEED = 24
#: Contexts of one name up to this number are ordered together in a task, more by a Spark sort of windows.
TOGETHER = 50_000
_CHUNK = 1 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _u64(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` over every ``width`` neighbours, by doubling."""
    have, m = 1, x
    while 2 * have <= width:
        m = f(m[: len(m) - have], m[have:])
        have *= 2
    rest = width - have
    return f(m[: len(m) - rest], m[rest:]) if rest else m


def _layout(texts: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer with ``pad`` zero bytes around each; starts and sizes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = pad + np.cumsum(sizes + pad) - sizes - pad
    buf = np.zeros(int((sizes + pad).sum()) + 2 * pad, np.uint8)
    for s, t in zip(starts, texts):
        buf[s : s + len(t)] = t
    return buf, starts, sizes


def seeds_of(texts: list[np.ndarray], length: int, seed: int) -> tuple[np.ndarray, ...]:
    """``text, offset, name, context`` of the seeds of some texts."""
    before, span = length - seed, 2 * length - seed
    buf, starts, sizes = _layout(texts, span + 8)
    eight = _u64(buf)
    n = len(buf) - seed
    h = eight[:n] * _ODD[0]
    for k in range(8, seed, 8):
        k = min(k, seed - 8)
        h ^= h >> np.uint64(29)
        h += eight[k : k + n]
        h *= _ODD[1]
    h ^= h >> np.uint64(32)
    h *= _ODD[2]
    g = np.maximum((h >> np.uint64(32)).astype(np.uint32), 1)
    least = _sliding(g, before + 1, np.minimum)
    valid = np.zeros(len(least), bool)
    for s, size in zip(starts, sizes):
        if size >= length:
            valid[s : s + size - length + 1] = True
    least[~valid] = 0
    most = np.zeros(len(g), np.uint32)
    run = _sliding(np.concatenate([np.zeros(before, np.uint32), least]), before + 1, np.maximum)
    most[: len(run)] = run[: len(most)]
    at = np.flatnonzero(g == most)
    text = np.searchsorted(starts, at, side="right") - 1
    offset = at - starts[text]
    context = np.minimum(offset, before).astype(np.uint64) * np.uint64(1 << 20) + np.minimum(
        sizes[text] - offset, length
    ).astype(np.uint64)
    for k in range(0, span, 8):
        context ^= context >> np.uint64(31)
        context *= _ODD[3]
        context += eight[at - before + min(k, span - 8)]
        context *= _ODD[1]
    context ^= context >> np.uint64(29)
    context *= _ODD[2]
    return text, offset, h[at].view(np.int64), (context ^ (context >> np.uint64(32))).view(np.int64)


def _bytes_of(column: pa.Array) -> list[np.ndarray]:
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _chunks(texts: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    begun, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _CHUNK or i + 1 == len(texts):
            yield begun, texts[begun : i + 1]
            begun, size = i + 1, 0


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals that overlap or touch, by row."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    base = np.concatenate([[0], np.cumsum(np.diff(row) != 0)]) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base) - base
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return row[at], start[at], np.maximum.reduceat(end, at)


def seed_tuples(rows: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``kind, d, t, a, b, name, context``: kind 0 are seeds at ``a`` whose windows end at ``b`` at most;
    kind 1 are spans from ``a`` to ``b`` that repeat an earlier place of the same batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column("d").to_numpy(zero_copy_only=False)
            t = batch.column("t").to_numpy(zero_copy_only=False)
            texts = _bytes_of(batch.column("text"))
            sizes = np.array([len(x) for x in texts], np.int64)
            parts = []
            for first, some in _chunks(texts):
                text, *rest = seeds_of(some, length, seed)
                parts.append([text + first, *rest])
            if not parts:
                continue
            text, offset, name, context = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((t, d))
            place = np.empty(len(d), np.int64)
            place[order] = np.concatenate([[0], np.cumsum((np.diff(d[order]) != 0) | (np.diff(t[order]) != 0))])
            order = np.lexsort((offset, place[text], context, name))
            text, offset, name, context = text[order], offset[order], name[order], context[order]
            new = np.ones(len(text), bool)
            new[1:] = (name[1:] != name[:-1]) | (context[1:] != context[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(text)), 0))
            again = (place[text] != place[text[first]]) | (offset != offset[first])
            low, high = np.maximum(offset - (length - seed), 0), np.minimum(offset + length, sizes[text])
            r, s, e = _merged(text[again], low[again], high[again])
            text, offset, high, name, context = (x[new] for x in (text, offset, high, name, context))
            row = np.concatenate([text, r])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(len(text), np.int32), np.ones(len(r), np.int32)])),
                    pa.array(d[row]),
                    pa.array(t[row]),
                    pa.array(np.concatenate([offset, s]).astype(np.int32)),
                    pa.array(np.concatenate([high, e]).astype(np.int32)),
                    pa.array(np.concatenate([name, d[r] * 31 + s])),
                    pa.array(np.concatenate([context, np.zeros(len(r), np.int64)])),
                ],
                ["kind", "d", "t", "a", "b", "name", "context"],
            )

    return rows.mapInArrow(run, "kind int, d long, t long, a int, b int, name long, context long")


def _windows(contexts: list[bytes], length: int, seed: int) -> np.ndarray:
    """Hashes of the windows over each context, by the window's place; contexts are padded to full span."""
    span = 2 * length - seed
    m = np.frombuffer(b"".join(contexts), np.uint8).reshape(len(contexts), span)
    factor = 0x5851F42D4C957F2D
    base, power = np.uint64(factor), np.uint64(pow(factor, length, 1 << 64))
    prefix = np.zeros((span + 1, len(m)), np.uint64)
    values = (np.arange(1, 257, dtype=np.uint64) * _ODD[0]) ^ (np.arange(1, 257, dtype=np.uint64) * _ODD[1] >> np.uint64(23))
    for c in range(span):
        prefix[c + 1] = prefix[c] * base + values[m[:, c]]
    return prefix[length:] - prefix[: span - length + 1] * power


def _repeats(d, t, a, left, right, contexts, name, length, seed):
    """Spans of rows sorted by name and place whose windows occur earlier under the same name."""
    hashes = _windows(contexts, length, seed)
    before = length - seed
    again = np.zeros((len(a), before + 3), bool)
    mixed = name.view(np.uint64) * _ODD[2]
    for j in range(before + 1):
        have = np.flatnonzero((left >= before - j) & (right >= seed + j))
        key = hashes[j][have] ^ mixed[have]
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(order), bool)
        same[1:] = key[order][1:] == key[order][:-1]
        again[have[order[same]], j + 1] = True
    turn = np.diff(again.astype(np.int8), axis=1)
    row, begin = np.nonzero(turn == 1)
    _, end = np.nonzero(turn == -1)
    return row, a[row] - before + begin, a[row] - before + end - 1 + length


def repeated_spans(rows: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``d, t, a, b``: spans of bytes, in whole windows, that an earlier place also has.

    ``rows`` are ``d, t, text``: the place of a window is ordered by ``d``, ``t`` and offset.
    """
    before, span = length - seed, 2 * length - seed
    by_context = W.partitionBy("name", "context").orderBy("d", "t", "a")
    by_name = W.partitionBy("name")
    sorted_ = (
        seed_tuples(rows, length, seed)
        .withColumn("least", F.min("context").over(by_name))
        .withColumn("most", F.max("context").over(by_name))
        .withColumn("n", F.count(F.lit(1)).over(by_name))
        .withColumn("rank", F.rank().over(by_context))
        .withColumn("whole", (F.col("kind") == 1) | (F.col("rank") > 1))
        .where(F.col("whole") | (F.col("least") != F.col("most")))
    )
    hits = materialise(sorted_.select("whole", "kind", "d", "t", "a", "b", "name", "n"), "seeds")
    low = F.when(F.col("kind") == 1, F.col("a")).otherwise(F.greatest(F.col("a") - before, F.lit(0)))
    whole = hits.where("whole").select("d", "t", low.alias("a"), "b")
    asked = (
        hits.where("not whole")
        .groupBy(F.col("d").alias("q_d"), F.col("t").alias("q_t"))
        .agg(F.collect_set(F.struct("a", "name", "n")).alias("asked"))
    )
    wanted = rows.join(asked, (F.col("d") == F.col("q_d")) & (F.col("t") == F.col("q_t"))).select("d", "t", "text", "asked")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("asked")
            bounds = np.asarray(lists.offsets)
            flat = lists.flatten()
            a = flat.field("a").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.repeat(np.arange(len(batch)), np.diff(bounds))
            texts = _bytes_of(batch.column("text"))
            size = np.array([len(x) for x in texts], np.int64)[at]
            cut = []
            for i, p in zip(at, a):
                x = texts[i]
                head = b"\0" * max(0, before - p)
                cut.append((head + x[max(0, p - before) : p + length].tobytes()).ljust(span, b"\0"))
            take = pa.array(at)
            for s in range(0, len(cut), 20_000):
                e = min(s + 20_000, len(cut))
                yield pa.RecordBatch.from_arrays(
                    [
                        flat.field("name").slice(s, e - s),
                        flat.field("n").slice(s, e - s),
                        batch.column("d").take(take.slice(s, e - s)),
                        batch.column("t").take(take.slice(s, e - s)),
                        pa.array(a[s:e]),
                        pa.array(np.minimum(a, before)[s:e]),
                        pa.array(np.minimum(size - a, length)[s:e]),
                        pa.array(cut[s:e], pa.binary()),
                    ],
                    ["name", "n", "d", "t", "a", "before", "after", "bytes"],
                )

    contexts = wanted.mapInArrow(
        fetch, "name long, n long, d long, t long, a long, before long, after long, bytes binary"
    )

    def columns(table: pa.Table) -> tuple:
        get = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        return get("d"), get("t"), get("a"), get("before"), get("after"), get("name")

    def spans(table: pa.Table) -> pa.RecordBatch:
        d, t, a, left, right, name = columns(table)
        new = np.ones(len(d), bool)
        new[1:] = (name[1:] != name[:-1]) | (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (a[1:] != a[:-1])
        keep = np.flatnonzero(new)
        contents = table.column("bytes").take(pa.array(keep)).to_pylist()
        row, s, e = _repeats(d[keep], t[keep], a[keep], left[keep], right[keep], contents, name[keep], length, seed)
        row = keep[row]
        return pa.RecordBatch.from_arrays(
            [pa.array(d[row]), pa.array(t[row]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["d", "t", "a", "b"]
        )

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows_held = 0
        for batch in batches:
            held.append(batch)
            rows_held += len(batch)
            if rows_held < TOGETHER:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            name = table.column("name").to_numpy()
            end = int(np.searchsorted(name, name[-1]))  # the last name may go on
            if end:
                yield spans(table.slice(0, end))
            held = table.slice(end).to_batches()
            rows_held = table.num_rows - end
        if rows_held:
            yield spans(pa.Table.from_batches(held).combine_chunks())

    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), 2_000):
                table = pa.Table.from_batches([batch.slice(s, 2_000)])
                d, t, a, left, right, name = columns(table)
                hashes = _windows(table.column("bytes").to_pylist(), length, seed)
                for j in range(before + 1):
                    have = np.flatnonzero((left >= before - j) & (right >= seed + j))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(name[have]),
                            pa.array(hashes[j][have].view(np.int64)),
                            pa.array(d[have]),
                            pa.array(t[have]),
                            pa.array((a[have] - before + j).astype(np.int32)),
                        ],
                        ["name", "w", "d", "t", "a"],
                    )

    few = (
        contexts.where(F.col("n") <= TOGETHER)
        .repartition("name")
        .sortWithinPartitions("name", "d", "t", "a")
        .mapInArrow(order, "d long, t long, a int, b int")
    )
    windows = contexts.where(F.col("n") > TOGETHER).mapInArrow(list_windows, "name long, w long, d long, t long, a int")
    firsts = windows.groupBy(F.col("name").alias("f_name"), F.col("w").alias("f_w")).agg(
        F.min(F.struct("d", "t", "a")).alias("first")
    )
    many = (
        windows.join(firsts, (F.col("name") == F.col("f_name")) & (F.col("w") == F.col("f_w")))
        .where(F.struct("d", "t", "a") > F.col("first"))
        .select("d", "t", "a", (F.col("a") + length).alias("b"))
    )
    parts = [whole, few]
    if hits.where((~F.col("whole")) & (F.col("n") > TOGETHER)).limit(1).count():
        parts.append(many)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every row; ``kept`` are the bytes that remain.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a document of a
    smaller id or earlier in its own. Strings are judged on the input and never cross documents.

    A null text is empty. A null id comes before all others. Rows of one id are ordered by
    their text's hash; rows that repeat as a whole are treated as one. An empty table gives no
    rows. Other columns of ``docs`` are not read. A very long text is read whole by one task, which
    needs some twenty bytes for each of its bytes.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    repeated_ids = base.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    rows = base.withColumn("t", F.xxhash64("text") if repeated_ids else F.lit(0).cast("long")).select("d", "t", "text")
    spans = (
        repeated_spans(rows, length, seed)
        .groupBy(F.col("d").alias("s_d"), F.col("t").alias("s_t"))
        .agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes_of(batch.column("text"))
            lists = batch.column("spans")
            bounds = np.asarray(lists.offsets)
            flat = lists.flatten()
            a = flat.field("a").to_numpy(zero_copy_only=False).astype(np.int64)
            b = flat.field("b").to_numpy(zero_copy_only=False).astype(np.int64)
            row, a, b = _merged(np.repeat(np.arange(len(batch)), np.diff(bounds)), a, b)
            bounds = np.searchsorted(row, np.arange(len(batch) + 1))
            kept, removed = [], []
            for i, x in enumerate(texts):
                s, e = a[bounds[i] : bounds[i + 1]], b[bounds[i] : bounds[i + 1]]
                cuts = zip(np.concatenate([[0], e]), np.concatenate([s, [len(x)]]))
                kept.append(b"".join(x[p:q].tobytes() for p, q in cuts) if len(s) else x.tobytes())
                removed.append(len(x) - len(kept[-1]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("d"),
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array(kept, pa.binary()),
                ],
                ["d", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    joined = rows.join(spans, (F.col("d") == F.col("s_d")) & (F.col("t") == F.col("s_t")), "left").select("d", "text", "spans")
    # an empty list keeps Arrow's offsets plain where a document has no span
    filled = joined.withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<a:int,b:int>>)")))
    return filled.mapInArrow(cut, "d long, n_bytes long, n_removed long, n_spans long, kept binary").select(
        F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept"
    )
