"""SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint is 8 bytes. Two that differ in at most ``radius`` bits share at least 8 - radius
bytes at the same positions. The index posts every distinct fingerprint under its bytes at a
few sets of positions, chosen so that whoever shares the guaranteed minimum of positions meets
in at least one list. In each list the positional bytes that a pair shares are tallied, pairs
that reach the minimum are kept and then verified by their bits.

The width of a key grows where the corpus needs it: lists over ``LIST`` fingerprints are posted
anew under more positions, then under half bytes of the positions left, until any list is short
or at most ``2 ** 12`` fingerprints can exist in it. No list is capped, and none gives back more
links than it has members: a forest that connects what is connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, fresh, materialise
from .simhash import vote, words

RADIUS = 3
#: Fingerprints of a posting list, at most, before its keys are made longer.
LIST = 1024


def shingle_hashes(df: DataFrame, keys: list[str], text: str, size: int = 3) -> DataFrame:
    """``keys, h``: the XXH64 (seed 42) of every ``size``-word shingle, repeats included.

    A text of fewer words gives one shingle of them all; a text without words gives hash 0.
    """
    w, n = F.col("w"), F.size("w")
    whole = n - (size - 1)
    columns = [F.slice(w, i + 1, F.greatest(whole, F.lit(0))).alias(f"w{i}") for i in range(size)]
    empty = F.col("text_words") == ""
    terms = (
        df.select(*keys, words(F.col(text)).alias("w"))
        .select(
            *keys,
            F.when(n >= size, F.lit("")).otherwise(F.array_join("w", " ")).alias("short"),
            (n >= size).alias("long"),
            F.explode_outer(F.arrays_zip(*columns)).alias("s"),
        )
        .withColumn(
            "text_words",
            F.when(F.col("long"), F.concat_ws(" ", *[F.col(f"s.w{i}") for i in range(size)])).otherwise(F.col("short")),
        )
    )
    return terms.select(*keys, F.when(empty, F.lit(0)).otherwise(F.xxhash64("text_words")).cast("long").alias("h"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``d, th, fp``: per id and text hash, the majority vote of its shingles' hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("th"), text.alias("text")
    )
    return vote(shingle_hashes(rows, ["d", "th"], "text", size), ["d", "th"], "h")


def position_sets(least: int, size: int, of: tuple[int, ...] = tuple(range(8))) -> list[tuple[int, ...]]:
    """Sets of ``size`` of the places ``of``, such that any ``least`` places hold at least one.

    Places fall into as many groups as leave one with ``size`` of any ``least``.
    """
    groups = max(1, (least - 1) // (size - 1)) if size > 1 else 1
    cut = [of[i * len(of) // groups : (i + 1) * len(of) // groups] for i in range(groups)]
    return [c for g in cut for c in combinations(g, size)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def key_masks(radius: int) -> list[dict[int, list[int]]]:
    """For each level of keys the longer keys (as bit masks) that may follow a key; level 0 has the one parent 0.

    Level 0 has sets of as many byte positions as two halves leave to one of them, level 1 all
    sets of the guaranteed minimum, level 2 the half bytes of the positions left that ``radius``
    bits must leave equal.
    """
    least = 8 - radius
    byte = lambda places: sum(0xFF << (8 * p) for p in places)
    first = position_sets(least, min(least, 3))
    more = {}
    for s in first:
        left = [p for p in range(8) if p not in s]
        more[byte(s)] = [byte(s) | byte(c) for c in combinations(left, least - len(s))]
    halves = {}
    for mask in {m for ms in more.values() for m in ms}:
        left = [h for h in range(16) if not mask >> (4 * h) & 0xF]
        halves[mask] = [mask | sum(0xF << (4 * h) for h in c) for c in combinations(left, max(0, len(left) - radius))]
    return [{0: [byte(s) for s in first]}, more, halves]


def tally(fps: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Positional bytes that each of ``fps`` shares with each of ``others``, counted position by position."""
    a, b = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) for x in (fps, others))
    shared = np.zeros((len(a), len(b)), np.uint8)
    for p in range(8):
        shared += a[:, p, None] == b[None, :, p]
    return shared


def _forest(fps: np.ndarray, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints at most ``radius`` bits apart that connect what is connected.

    The pairs of the list are tallied a block at a time; at most one link less than there are members is kept.
    """
    root = np.arange(len(fps))
    a, b = [], []
    for i in range(0, len(fps), block):
        for j in range(i, len(fps), block):
            x, y = np.nonzero(tally(fps[i : i + block], fps[j : j + block]) >= 8 - radius)
            x, y = x + i, y + j
            near = (x < y) & (np.bitwise_count(fps[x] ^ fps[y]) <= radius)
            x, y = x[near], y[near]
            while len(apart := np.flatnonzero(root[x] != root[y])):
                x, y = x[apart], y[apart]
                # the first link of each root that hangs below a smaller one joins them
                high, low = np.maximum(root[x], root[y]), np.minimum(root[x], root[y])
                high, at = np.unique(high, return_index=True)
                a.append(fps[x[at]])
                b.append(fps[y[at]])
                root[high] = low[at]
                while (root[root] != root).any():
                    root = root[root]
    none = np.zeros(0, fps.dtype)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links that connect exactly the fingerprints connected at ``radius`` bits.

    ``distinct`` holds distinct longs ``fp``. A list is a mask and the bits under it. Lists of
    ``LIST`` fingerprints and less are compared; the others are posted again under longer keys,
    as partial counts tell which these are. Every pair within the radius shares a key of each level.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("fps")
            bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            found = [_forest(flat[s:e], radius) for s, e in zip(bounds[:-1], bounds[1:])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found)], ["a", "b"])

    levels = key_masks(radius)
    posted, out = distinct.select("fp", F.lit(0).cast("long").alias("mask")), []
    for level, masks in enumerate(levels):
        table = F.create_map(*[x for m, longer in masks.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)) for k in longer]))])
        entries = posted.select("fp", F.explode(table[F.col("mask")]).alias("mask")).distinct() if level else posted.select(
            "fp", F.explode(table[F.lit(0)]).alias("mask")
        )
        entries = entries.withColumn("k", F.col("fp").bitwiseAND(F.col("mask")))
        counts = entries.groupBy(F.col("mask").alias("l_mask"), F.col("k").alias("l_k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = entries.join(counts, (F.col("mask") == F.col("l_mask")) & (F.col("k") == F.col("l_k")))
        last = level + 1 == len(levels)
        met = materialise(met.select("fp", "mask", "k", "n"), "postings") if not last else met
        short = met if last else met.where(F.col("n") <= LIST)
        out.append(short.groupBy("mask", "k").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(link, "a long, b long"))
        posted = met.where(F.col("n") > LIST)
        if not last and posted.isEmpty():
            break
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable from each end of ``a, b``; roots themselves left out.

    Alternating large-star and small-star rounds until nothing changes; each round moves links
    to smaller nodes, so they end. Each round is written to the shared folder. The star of a
    node is its minimum, taken by partial aggregation.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            near = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        else:
            near = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = near.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "m_u"))
        met = near.join(low, F.col("u") == F.col("m_u"))
        if large:
            out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("m_u", "m"))
        return out.where(F.col("a") != F.col("b")).distinct()

    now, last = edges, None
    while True:
        now = materialise(star(star(now, True), False), "star")
        told = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = told


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, size: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, th, fp, root, component_id`` of every row.

    ``th`` is the text's hash, ``root`` the smallest fingerprint of the component.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest
    id reachable over links, the row's own included. Copies meet as one fingerprint before
    any comparison.

    A null text is empty; texts without words have fingerprint 0 and link like any other. A
    null id is the smallest of all: a component that holds one has component_id null. Rows
    of one id and different texts are separate nodes. Repeated rows get equal values. An
    empty table gives no rows. Other columns of ``docs`` are not read. A very long text is split
    by one task, which holds its words; only its fingerprint travels.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, size), "fps")
    distinct = materialise(fps.groupBy("fp").agg(F.min("d").alias("low")), "distinct")
    found = components(materialise(links(distinct.select("fp"), radius), "links"))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    lows = rooted.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("component"))
    classes = rooted.join(lows, F.col("root") == F.col("r")).select(F.col("fp").alias("c_fp"), "root", "component")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("r_d"), F.xxhash64(text).alias("r_th"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return (
        rows.join(fps, (F.col("r_d") == F.col("d")) & (F.col("r_th") == F.col("th")))
        .join(classes, F.col("fp") == F.col("c_fp"))
        .select(real("d").alias("doc_id"), "th", "fp", "root", real("component").alias("component_id"))
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (then text hash).

    The row to keep is a partial minimum, no component is gathered. Rows that repeat as a
    whole count once. A null id is the smallest; texts without words, null ones among them, are one
    component. Of rows that tie in id and text hash one stays. An empty table gives no rows.
    """
    d, th, k_d, k_th = fresh(docs, "d", "th", "k_d", "k_th")
    keep = (
        near_duplicates(docs)
        .groupBy("root")
        .agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "th")).alias("s"))
        .select(F.col("s.d").alias(k_d), F.col("s.th").alias(k_th))
    )
    marked = docs.withColumns(
        {d: F.coalesce(F.col("doc_id"), F.lit(NO_ID)), th: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))}
    )
    kept = marked.join(keep, (F.col(d) == F.col(k_d)) & (F.col(th) == F.col(k_th)), "left_semi")
    return kept.dropDuplicates([d, th]).select(*docs.columns)
