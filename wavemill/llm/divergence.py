"""How far the sources of a language are apart in their words: pairs of sources, and each source's telling terms.

Counts by (language, source, term) are summed in a task before they are shuffled. Distances
between all pairs of a language's sources are sums over all kept terms, of which most sources
lack most terms. So terms are split by the number of groups that hold them:

* Every pair begins with what it has if no group holds any term: ``V`` times the distance of the
  two groups' smallest shares.
* Heavy terms, in more than ``HEAVY`` groups, become dense tiles of ``TILE_TERMS`` terms by
  ``TILE_GROUPS`` x ``TILE_GROUPS`` groups, which NumPy subtracts whole.
* Light terms correct the start: one side at a time from each group's histogram of shares, and
  then by the pairs within a term's posting list, which has ``HEAVY`` entries at most.

All parts are integers, so their sum is exact whatever their order.

What holds for all functions here:

* Nulls: a null text, language or source is the empty string. No other column is read, so extra
  columns of any name do not matter.
* A group without words (empty texts) still has its rows; a language with no kept term has
  distance 0 between all its sources and no term rows. An empty table gives an empty result.
* Repeated rows are documents of their own. Ties are ranked by the item's UTF-8 bytes.
* Very long texts are read in slices; a task holds the words of ``FLUSH_WORDS`` or of its longest
  text, at about 60 bytes each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise
from .words import byte_class, coded, split_words

LEAST_DOCUMENTS = 30
TOP_TERMS = 50
SCALE, PRIOR = 1_000_000_000, 5

#: A term in more groups than this is heavy.
HEAVY = 16
TILE_TERMS, TILE_GROUPS = 1024, 64
FLUSH_WORDS = 1 << 20

#: Letters and all that is not ASCII.
_LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def _named(docs: DataFrame, *more: Column) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), *more)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term in a group and the documents there that hold it."""

    def summed(langs: list, sources: list, words: list, sizes: list) -> pa.RecordBatch:
        codes, terms = coded(words)
        lang, langs_ = coded(langs)
        source, sources_ = coded(sources)
        many, counts = len(terms), np.concatenate(sizes)
        key = np.repeat(np.arange(len(counts)), counts) * many + codes
        key.sort()
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n, key = np.diff(np.append(heads, len(key))), key[heads]  # by document and term
        group = (lang.astype(np.int64) * len(sources_) + source)[key // many]
        key = group * many + key % many
        by = np.argsort(key)
        key, n = key[by], n[by]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        docs_, n, key = np.diff(np.append(heads, len(key))), np.add.reduceat(n, heads), key[heads]
        group = key // many
        taken = lambda values, at: values.take(pa.array(at))
        columns = [taken(langs_, group // len(sources_)), taken(sources_, group % len(sources_)), taken(terms, key % many)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(docs_, pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, sources, words, sizes, held = [], [], [], [], 0
        for batch in batches:
            for first, found in split_words(batch.column(2), _LETTERS):
                rows = len(found.counts)
                langs.append(batch.column(0).slice(first, rows))
                sources.append(batch.column(1).slice(first, rows))
                words.append(found.text)
                sizes.append(found.counts)
                held += len(found.text)
                if held >= FLUSH_WORDS:
                    yield summed(langs, sources, words, sizes)
                    langs, sources, words, sizes, held = [], [], [], [], 0
        if held:
            yield summed(langs, sources, words, sizes)

    parts = _named(docs, F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share ``1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms))``; null where there are no terms."""
    over = (count + F.lit(PRIOR)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = total.cast("decimal(19,0)") + terms.cast("decimal(18,0)") * F.lit(PRIOR).cast("decimal(1,0)")
    whole = F.call_function("div", over, F.nullif(under, F.lit(0).cast("decimal(20,0)")))
    return whole + F.lit(1)


def kept_postings(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, source, term, n, n_lang, groups, first`` of terms in ``least`` documents of the language or more.

    ``n_lang`` sums over the language, ``groups`` counts the sources that hold the term, and
    ``first`` marks one posting of each term.
    """
    own = W.partitionBy("lang", "term")
    counted = term_counts(docs).withColumns(
        {
            "first": F.row_number().over(own.orderBy("source")) == 1,
            "df": F.sum("docs").over(own),
            "n_lang": F.sum("n").over(own),
            "groups": F.count(F.lit(1)).over(own),
        }
    )
    return materialise(counted.where(F.col("df") >= least).drop("docs", "df"), "divergence-postings")


def _groups(docs: DataFrame, kept: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``lang, source, gid, total, lang_total, terms, heavy, base``: every group with what its shares need.

    ``gid`` numbers a language's sources from 0; ``base`` is the share of a term that the group lacks.
    """
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(
        F.sum("n").alias("lang_total"),
        F.sum(F.col("first").cast("long")).alias("terms"),
        F.sum((F.col("first") & (F.col("groups") > heavy)).cast("long")).alias("heavy"),
    )
    met = _named(docs).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    met = met.na.fill(0, ["total", "lang_total", "terms", "heavy"])
    gid = (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("int")
    return materialise(met.withColumns({"gid": gid, "base": share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))}), "divergence-groups")


_PAIRS = "lang string, i int, j int, f long"


def _pair_rows(lang: str, i: np.ndarray, j: np.ndarray, f: np.ndarray) -> pa.Table:
    return pa.table({"lang": pa.array([lang] * len(f), pa.string()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "f": pa.array(f, pa.int64())})


def _one_sided(held: np.ndarray, times: np.ndarray, own: int, others: np.ndarray) -> np.ndarray:
    """What a group's light terms (shares ``held``, each so many ``times``) add to its distance from groups that lack them."""
    by = np.argsort(held)
    held, times = held[by], times[by]
    count, total = np.concatenate([[0], np.cumsum(times)]), np.concatenate([[0], np.cumsum(held * times)])
    below = np.searchsorted(held, others)
    far = (total[-1] - total[below]) - (count[-1] - count[below]) * others + count[below] * others - total[below]
    return far - count[-1] * np.abs(own - others)


def _tile_of(size: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Partial distances of the pairs between two blocks of ``size`` groups: over a block of heavy terms, or (``part`` -1) of light terms one side at a time."""

    def tile(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang, part, bi, bj = (k.as_py() for k in key)
        gid, p, times = (table[c].to_numpy() for c in ("gid", "p", "times"))
        base = times == 0
        ids, at = np.unique(gid[base], return_index=True)
        lows = p[base][at]
        i, j = np.flatnonzero(ids // size == bi), np.flatnonzero(ids // size == bj)
        apart = np.abs(lows[i][:, None] - lows[j][None, :])
        place = np.searchsorted(ids, gid)
        if part < 0:
            own = np.split(np.argsort(place[~base], kind="stable"), np.cumsum(np.bincount(place[~base], minlength=len(ids)))[:-1])
            hist_p, hist_n = p[~base], times[~base]
            side = lambda rows, others: np.array([_one_sided(hist_p[own[g]], hist_n[own[g]], lows[g], lows[others]) for g in rows], np.int64).reshape(len(rows), len(others))
            f = apart * int(table["terms"][0].as_py()) + side(i, j) + side(j, i).T
        else:
            codes, terms = coded([c for c in table["term"].filter(pa.array(~base)).chunks])
            dense = np.repeat(lows[:, None], len(terms), axis=1)
            dense[place[~base], codes] = p[~base]
            f = np.array([np.abs(dense[g] - dense[j]).sum(1) for g in i], np.int64).reshape(len(i), len(j)) - apart * len(terms)
        a, b = np.nonzero(ids[i][:, None] < ids[j][None, :])
        return _pair_rows(lang, ids[i][a], ids[j][b], f[a, b])

    return tile


def _posting_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections for two groups that both hold a light term, summed over a batch of terms."""
    for batch in batches:
        langs = batch.column(0)
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        gid, p, low = (flat.field(k).to_numpy() for k in range(3))
        lang, names = coded([langs])
        first = np.cumsum(sizes) - sizes
        keys, sums = [], []
        width = int(gid.max()) + 1 if len(gid) else 1
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            for a in range(size):
                for b in range(a + 1, size):
                    x, y = first[rows] + a, first[rows] + b
                    f = np.abs(p[x] - p[y]) - np.abs(p[x] - low[y]) - np.abs(p[y] - low[x]) + np.abs(low[x] - low[y])
                    keys.append((lang[rows].astype(np.int64) * width + gid[x]) * width + gid[y])
                    sums.append(f)
        if keys:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, np.concatenate(sums))
            columns = [names.take(pa.array(key // width // width)), pa.array(key // width % width, pa.int32()), pa.array(key % width, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total)], ["lang", "i", "j", "f"])


def pair_distances(groups: DataFrame, kept: DataFrame, heavy: int = HEAVY, tile: tuple[int, int] = (TILE_TERMS, TILE_GROUPS)) -> DataFrame:
    """``lang, i, j, f`` (i < j) of all pairs of a language's groups: the sum over its kept terms of the distance of their shares."""
    size = tile[1]
    facts = groups.select("lang", "source", "gid", "total", "terms", "heavy", "base")
    shared = kept.join(facts, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    light = F.col("groups") <= heavy
    blocks = groups.groupBy("lang").agg(F.floor((F.max("gid") + size) / size).cast("int").alias("blocks"))
    parts = F.ceil(F.col("heavy") / tile[0]).cast("int")
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("long")
    # each row goes to the tiles of its block with every block
    base = facts.select(
        "lang", F.explode(F.sequence(F.lit(-1), parts - 1)).alias("part"), "gid", none.alias("term"), F.coalesce("base", zero).alias("p"), zero.alias("times"), "terms"
    )
    once = shared.where(light).groupBy("lang", "gid", "p", "terms").agg(F.count(F.lit(1)).alias("times"))
    once = once.select("lang", F.lit(-1).alias("part"), "gid", none.alias("term"), "p", "times", "terms")
    dense = shared.where(~light).select(
        "lang", F.pmod(F.xxhash64("term"), parts).cast("int").alias("part"), "gid", "term", "p", F.lit(1).cast("long").alias("times"), "terms"
    )
    rows = base.unionByName(once).unionByName(dense).join(blocks, "lang")
    block = F.floor(F.col("gid") / size).cast("int")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"bi": F.least(block, "other"), "bj": F.greatest(block, "other")}
    )
    tiles = rows.groupBy("lang", "part", "bi", "bj").applyInArrow(_tile_of(size), _PAIRS)
    lists = shared.where(light & (F.col("groups") > 1)).groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("gid", "p", "base"))).alias("list"))
    corrections = lists.select("lang", "list").mapInArrow(_posting_pairs, _PAIRS)
    return tiles.unionByName(corrections).groupBy("lang", "i", "j").agg(F.sum("f").alias("f"))


def telling_terms(groups: DataFrame, kept: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, item, value, rank``: the terms whose share in a group is most above that in its language."""
    met = kept.join(groups.select("lang", "source", "total", "lang_total", "terms"), ["lang", "source"])
    gain = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("n_lang"), F.col("lang_total"), F.col("terms"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    more = met.select("lang", "source", F.col("term").alias("item"), gain.alias("value")).where("value > 0")
    return more.withColumn("rank", rank).where(F.col("rank") <= top)


def audit(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, heavy: int = HEAVY, tile: tuple[int, int] = (TILE_TERMS, TILE_GROUPS)
) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs`` (``lang, source, text``): every source's distance from every
    other of its language (``pair``) and its ``top`` terms (``term``)."""
    kept = kept_postings(docs, least)
    groups = _groups(docs, kept, heavy)
    pairs = pair_distances(groups, kept, heavy, tile)
    names = groups.select("lang", F.col("gid").alias("i"), "source")
    both = pairs.select("lang", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("d"), F.col("f").alias("value"))
    both = both.select("lang", "d.i", "d.j", "value").join(names, ["lang", "i"]).join(names.withColumnsRenamed({"i": "j", "source": "item"}), ["lang", "j"])
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = both.select("lang", "source", "item", "value").withColumn("rank", rank)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(ranked, "pair").unionByName(columns(telling_terms(groups, kept, top), "term"))
