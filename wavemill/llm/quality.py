"""Quality rules as a short-circuit cascade. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, fresh, strip_spaces

WINDOW = 5
#: Rows, about, of the sample that cost and selectivity are estimated on.
SAMPLE_ROWS = 1_500
#: Words of a block that distinct words are counted in; more words repeat in a longer text.
BLOCK = 1_000
SYMBOLS = r"[#*$%&|<>]"


def _stats(docs: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the base figures; the second value maps their plain names to the columns'.

    What is used more than once is a column of its own, so that it is computed once.
    """
    plain = ["text", "w", "two", "four", "h", "again", "places", "starts", "lines", "n_words", "word_chars"]
    plain += ["n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
    at = dict(zip(plain, fresh(docs, *plain)))
    c = {k: F.col(v) for k, v in at.items()}
    words = F.split(strip_spaces(c["text"]), SPACE_RE)
    lines = F.filter(F.split(c["text"], "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))

    def joined(a: Column, b: Column, apart: int, less: int) -> Column:
        """Hashes of what starts at each word and what starts ``apart`` words on."""
        n = F.greatest(F.size(c["w"]) - less, F.lit(0))
        return F.zip_with(F.slice(a, 1, n), F.slice(b, apart + 1, n), lambda x, y: F.xxhash64(x, y))

    # places of windows found twice or more: neighbours after sorting by hash
    by_hash = F.array_sort(F.transform(c["h"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    near = F.arrays_zip(
        c["places"].alias("x"),
        F.slice(c["places"], 2, F.size(c["places"])).alias("after"),
        F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), c["places"]).alias("before"),
    )
    repeated = F.filter(
        near,
        lambda z: z["x"].isNotNull() & ((z["x"]["h"] == z["after"]["h"]) | (z["x"]["h"] == z["before"]["h"])),
    )
    in_order = F.array_sort(F.transform(repeated, lambda z: z["x"]["i"]))
    gaps = F.zip_with(
        c["starts"],
        F.slice(c["starts"], 2, F.size(c["starts"])),
        lambda x, y: F.coalesce(F.least(y - x, F.lit(WINDOW)), F.lit(WINDOW)),
    )
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda n, g: n + g)
    out = (
        docs.withColumn(at["text"], F.coalesce(F.col(text_col), F.lit("")))
        .withColumn(at["w"], words)
        .withColumn(at["two"], joined(c["w"], c["w"], 1, 1))
        .withColumn(at["four"], joined(c["two"], c["two"], 2, 3))
        .withColumns({at["h"]: joined(c["four"], c["w"], 4, 4), at["lines"]: lines})
        .withColumn(at["again"], F.size(F.array_distinct(c["h"])) != F.size(c["h"]))
        .withColumn(at["places"], F.when(c["again"], by_hash))
        .withColumn(at["starts"], F.when(c["again"], in_order))
        .withColumns(
            {
                at["n_words"]: F.when(c["w"][0] == "", 0).otherwise(F.size(c["w"])).cast("long"),
                at["word_chars"]: F.char_length(F.array_join(c["w"], "")).cast("long"),
                at["n_symbols"]: F.regexp_count(c["text"], F.lit(SYMBOLS)).cast("long"),
                at["n_lines"]: F.size(c["lines"]).cast("long"),
                at["n_dup_lines"]: (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long"),
                at["n_repeat_words"]: F.when(c["again"], covered).otherwise(F.lit(0).cast("long")),
            }
        )
    )
    return out, at


def rules(at: dict[str, str]) -> dict[str, Column]:
    """What each rule rejects. Thresholds leave ordinary prose well inside."""
    c = {k: F.col(v) for k, v in at.items()}
    count = lambda p: F.regexp_count(c["text"], F.lit(p))
    # the distinct words of each block of BLOCK words, summed: a text of one block is as a whole
    blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(c["w"]) - 1) / BLOCK), F.lit(0)).cast("int"))
    distinct = F.aggregate(
        blocks, F.lit(0), lambda n, i: n + F.size(F.array_distinct(F.slice(c["w"], i * BLOCK + 1, F.lit(BLOCK))))
    )
    return {
        "symbols": 10 * c["n_symbols"] > c["n_words"],
        "repeated lines": 5 * c["n_dup_lines"] > 2 * c["n_lines"],
        "exclamations": 2 * count("!") > c["n_words"],
        "capitals": 2 * count(r"\p{Lu}") > c["word_chars"],
        "few distinct words": 4 * distinct < c["n_words"],
    }


def work(at: dict[str, str]) -> dict[str, Column]:
    """What each rule costs a row: the characters it reads, and one for each ready figure."""
    c = {k: F.col(v) for k, v in at.items()}
    characters = F.char_length(c["text"])
    return {
        "symbols": F.lit(2),
        "repeated lines": F.lit(2),
        "exclamations": characters + 1,
        "capitals": characters + 1,
        "few distinct words": c["word_chars"] + c["n_words"] + 1,
    }


def estimate(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """``rule, cost, share rejected`` on a sample, by rejection per cost, best first.

    The sample are the rows whose hash (of all numbers and strings) falls in the share that
    gives about ``sample_rows``, so it is the same on every run and however rows are dealt.
    The order only decides how soon a row is settled: a row is kept if no rule rejects it.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    keys = [f.name for f in docs.schema if f.dataType.typeName() in ("string", "long", "integer", "short", "byte")]
    place = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys or [text_col]]), F.lit(1 << 32)) / float(1 << 32)
    stats, at = _stats(docs.where(place < share), text_col)
    names, tests, costs = list(rules(at)), rules(at), work(at)
    row = stats.agg(
        F.count(F.lit(1)), *[F.sum(tests[n].cast("long")) for n in names], *[F.sum(costs[n].cast("double")) for n in names]
    ).first()
    n = max(row[0], 1)
    rejected, spent = row[1 : len(names) + 1], row[len(names) + 1 :]
    found = [(name, max((c or 0) / n, 1.0), (r or 0) / n) for name, r, c in zip(names, rejected, spent)]
    return sorted(found, key=lambda r: (-r[2] / r[1], r[1], r[0]))


def judge(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    Words are runs without white space; windows are ``WINDOW`` words and compared by 64-bit
    hashes within a document. ``base_failed`` marks fewer than 10 words, or more than a fifth
    of the words in repeated windows. The rules run as one CASE, the ones that reject most for
    their cost on a sample first, so that a rejected row skips the rest; ``kept`` is false if
    the base or any rule rejects.

    A null or empty text has no words, so the base rejects it. Nothing is compared between
    rows: repeated rows get equal values, an empty table gives no rows. Columns of ``docs``
    with the result's names are replaced. A very long text is judged whole by one task, which
    holds its words and the hashes of its windows.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    keep = [c for c in docs.columns if c.lower() not in names]
    order = estimate(docs.select(*keep), text_col, sample_rows)
    stats, at = _stats(docs.select(*keep), text_col)
    all_rules = rules(at)
    cascade: Column = F.lit(True)
    for name, _, _ in reversed(order):
        cascade = F.when(all_rules[name], F.lit(False)).otherwise(cascade)
    failed = (F.col(at["n_words"]) < 10) | (100 * F.col(at["n_repeat_words"]) > 20 * F.col(at["n_words"]))
    return stats.select(
        *keep,
        *[F.col(at[n]).alias(n) for n in names[:5]],
        failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(cascade).alias("kept"),
    )
