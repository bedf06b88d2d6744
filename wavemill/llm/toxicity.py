"""Toxicity by noisy-channel deobfuscation.

Words that look disguised (letters swapped for digits or marks, spaced or dotted letters,
stretched letters) become character lattices. A Viterbi search under a character trigram
model, counted over the whole corpus, picks the likeliest plain reading. The restored words
are then scored by a logistic model whose words and weights are learned from labels.

The language model reads code points. Its letters are a to z and those that the corpus uses
often enough to tell apart; all other letters are one symbol.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, fresh, materialise
from .near_dup import shingle_hashes
from .packing import _slices

#: Labelled rows that the classifier is fitted on, of each class at most; taken by hash of the id.
TRAIN_ROWS = 8_000
#: A word is weighed if its share among toxic rows is ``LIFT`` times that among the others, and so far
#: from chance that twice the log likelihood ratio reaches ``SIGNIFICANCE`` (one word in 10,000 by chance).
LIFT, SIGNIFICANCE = 3.0, 15.14
#: Letters of the beginnings. Endings vary in many languages, so a stem tells more than each of its forms.
STEMS = (4, 5, 6)
#: A letter besides a to z has a symbol of its own if it is at least this share of all letters.
LETTER_SHARE = 1e-4
#: Symbols up to which trigrams are counted in a plain table (16 MB), and over which in a sorted list of those in use.
_TABLE = 128
#: Readings that a worker remembers, and words with what they tell the classifier.
READINGS, TOLD = 50_000, 200_000

# Which letters a mark may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "§": "s", "(": "c", "*": "aeiou",
}
SEPARATORS = " .-_~'`^*/\\​‌­"
#: Logarithm of the chance that a writer means a mark as itself.
AS_ITSELF = -6.0

_LATIN = "abcdefghijklmnopqrstuvwxyz"
_STRIP_END = ".,!?;:|*%$&#\"')]}>"
_STRIP_START = "\"'([{<|*#&%.,;:"
_AT_END, _AT_START = ({x for c in marks for x in STANDS_FOR.get(c, "")} for marks in (_STRIP_END, _STRIP_START))
#: Punctuation alone, which may stand between spaced letters.
_BETWEEN = "".join(c for c in dict.fromkeys(_STRIP_END + _STRIP_START + SEPARATORS) if c not in STANDS_FOR)
_DISGUISED = re.compile(
    r"(?=.*[^\W\d_])(?:.*[0-9@$!|+€£§(*].*|.*([^\W\d_])\1\1.*|\w(?:[.\-_~'`^*/\\​‌­]+\w){3,}|.*[​‌­].*)",
    re.DOTALL,
)
_DOUBLE = re.compile(r"([^\W\d_])\1+")


def _code_points(texts: pa.Array) -> np.ndarray:
    """The lower-cased texts' code points, texts set apart by line ends."""
    return np.frombuffer("\n".join(["", *pc.utf8_lower(texts).to_pylist(), ""]).encode("utf-32-le"), np.uint32)


def letter_counts(docs: DataFrame) -> DataFrame:
    """``code, n``: how often each code point occurs in all texts, lower-cased."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for a, b in _slices(texts):
                some = np.bincount(_code_points(texts.slice(a, b - a)))
                total[: len(some)] += some
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    return docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def alphabet(counts: DataFrame) -> str:
    """The letters with a symbol of their own: a to z, then others in order of their code point.

    To the driver comes a row for each code point in use at most, whatever the corpus.
    """
    n = {chr(r["code"]): r["n"] for r in counts.collect() if chr(r["code"]).isalpha()}
    least = LETTER_SHARE * sum(n.values())
    return _LATIN + "".join(sorted(c for c, k in n.items() if k >= least and c not in _LATIN))


def character_counts(docs: DataFrame, letters: str = _LATIN) -> DataFrame:
    """``code, n``: how often each trigram of symbols occurs in all texts.

    Symbol 0 is no letter, the letters follow from 1 on, and the last is any other letter.
    """
    size = len(letters) + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = np.array([ord(c) for c in letters], np.uint32)
        order = np.argsort(symbol)
        known = np.zeros(0x110000, np.int16)
        known[symbol[order]] = order + 1
        asked = np.zeros(0x110000, bool)
        asked[:128] = asked[symbol] = True
        found, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        table = np.zeros(size**3 if size <= _TABLE else 0, np.int64)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for a, b in _slices(texts):
                codes = _code_points(texts.slice(a, b - a))
                for c in np.unique(codes[~asked[codes]]):
                    known[c] = (size - 1) * chr(c).isalpha()
                    asked[c] = True
                s = known[codes].astype(np.int64)
                if len(s) > 2 and len(table):
                    table += np.bincount((s[:-2] * size + s[1:-1]) * size + s[2:], minlength=len(table))
                elif len(s) > 2:
                    at, n = np.unique((s[:-2] * size + s[1:-1]) * size + s[2:], return_counts=True)
                    found, where = np.unique(np.concatenate([found, at]), return_inverse=True)
                    sums = np.bincount(where, np.concatenate([sums, n]), len(found)).astype(np.int64)
        if len(table):
            found = np.flatnonzero(table)
            sums = table[found]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums)], ["code", "n"])

    return docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log chances of a symbol after two others; trigrams backed by pairs backed by single symbols.

    It holds the trigrams that occur, so it grows with what the corpus shows and not with the
    third power of the alphabet.
    """

    def __init__(self, letters: str, counts: dict[int, int]):
        self.place = {c: i + 1 for i, c in enumerate(letters)}
        self.size = size = len(letters) + 2
        codes = np.array(sorted(counts), np.int64)
        n = np.array([counts[c] for c in codes.tolist()], float)
        single = (np.bincount(codes % size, n, size) + 1) / (n.sum() + size)
        follows = np.bincount(codes % size**2, n, size**2).reshape(size, size)
        after_one = np.bincount(codes // size % size, n, size)
        self.pair = (follows + 5 * single) / (after_one[:, None] + 5)
        self.seen = np.bincount(codes // size, n, size**2).reshape(size, size)
        self.triple = dict(zip(codes.tolist(), n.tolist()))

    def symbol(self, c: str) -> int:
        return self.place.get(c) or (self.size - 1 if c.isalpha() else 0)

    def chance(self, a: int, b: int, c: int) -> float:
        n = self.triple.get((a * self.size + b) * self.size + c, 0.0)
        return math.log((n + 5 * self.pair[b, c]) / (self.seen[a, b] + 5))


def language_model(docs: DataFrame) -> LanguageModel:
    """The model counted over all texts. To the driver come the code points and trigrams in use, with their sums."""
    letters = alphabet(letter_counts(docs))
    return LanguageModel(letters, {r["code"]: r["n"] for r in character_counts(docs, letters).collect()})


def _lattice(word: str) -> list[list[tuple[str, float]]]:
    out, i = [], 0
    while i < len(word):
        c = word[i]
        j = i
        while j < len(word) and word[j] == c:
            j += 1
        if c.isalpha():
            out.append([(c, 0.0)] if j - i == 1 else [(c, 0.0), (c + c, 0.0)])
        elif c in STANDS_FOR:
            for _ in range(j - i if c != "*" else 1):
                options = [(x, 0.0) for x in STANDS_FOR[c]] + [(" ", AS_ITSELF)]
                out.append(options + [("", -1.0)] if c in SEPARATORS else options)
        elif c in SEPARATORS:
            out.append([("", 0.0), (" ", 0.0)])
        else:
            out.append([(" ", 0.0)])
        i = j
    return out


def _spells(marks: str, letters: str) -> bool:
    """Whether the letters can be read off the marks, in order, with other marks left out."""
    left = iter(marks)
    return all(any(c in STANDS_FOR.get(m, "") for m in left) for c in letters)


class Restorer:
    """Plain readings of words, remembered up to a bound."""

    def __init__(self, model: LanguageModel, known: frozenset[str] = frozenset()):
        self.model = model
        self.known = known
        self.bare = {_DOUBLE.sub(r"\1", w): w for w in sorted(known)}
        #: what known words leave without letters that marks at their edges may stand for
        self.inner: dict[str, list[tuple[str, str, str]]] = {}
        for w in sorted(known):
            heads = next((i for i, c in enumerate(w) if c not in _AT_START), len(w))
            tails = next((i for i, c in enumerate(reversed(w)) if c not in _AT_END), len(w))
            for i in range(heads + 1):
                for j in range(max(i + 1, len(w) - tails), len(w) + 1):
                    if i or j < len(w):
                        self.inner.setdefault(w[i:j], []).append((w[:i], w[j:], w))
        self.seen: dict[str, tuple[str, ...]] = {}
        self.held: dict[str, tuple[int, tuple[int, ...]]] = {}

    def read(self, word: str) -> tuple[str, ...]:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= READINGS:
                self.seen.clear()
            got = self.seen[word] = self._read(word)
        return got

    def told(self, word: str, places: dict[str, int]) -> tuple[int, tuple[int, ...]]:
        """The word's kind (see :func:`_kind`) and the places of its features. One restorer is asked with the same places only."""
        got = self.held.get(word)
        if got is None:
            if len(self.held) >= TOLD:
                self.held.clear()
            found = tuple(places[f] for x in self._read(word) for f in features_of(x) if f in places)
            got = self.held[word] = (_kind(word), found)
        return got

    def _read(self, word: str) -> tuple[str, ...]:
        core = word.rstrip(_STRIP_END).lstrip(_STRIP_START)
        if not core:
            return ()
        plain = self._plain(core)
        if not self.inner or any(w in self.known for w in plain):
            return plain
        # marks at the edges are letters where they complete a known word, and else punctuation
        at = word.index(core)
        before, after = word[:at], word[at + len(core) :]
        if any(c in STANDS_FOR for c in before + after):
            if not any(c.isalpha() for c in core) and any(c in STANDS_FOR for c in core):
                plain = self.decode(core)
            for head, tail, w in self.inner.get("".join(plain), ()):
                if _spells(before, head) and _spells(after, tail):
                    return (w,)
        return plain

    def _plain(self, core: str) -> tuple[str, ...]:
        if core in self.known or (core.isalpha() and not _DOUBLE.search(core)):
            return (core,)
        if _DISGUISED.fullmatch(core) or " " in core or _DOUBLE.sub(r"\1", core) in self.bare:
            return self.decode(core)
        return (core,)

    def likeliest(self, word: str) -> tuple[float, str]:
        """The best path through the word's lattice: its log chance and what it reads."""
        symbol, chance = self.model.symbol, self.model.chance
        best: dict[tuple[int, int], tuple[float, object]] = {(0, 0): (0.0, None)}
        for options in _lattice(word):
            after: dict[tuple[int, int], tuple[float, object]] = {}
            for (a, b), (score, path) in best.items():
                for text, cost in options:
                    s, x, y = score + cost, a, b
                    for c in text:
                        k = symbol(c)
                        if k or y:  # one boundary between words
                            s += chance(x, y, k)
                            x, y = y, k
                    if (x, y) not in after or s > after[x, y][0]:
                        after[x, y] = (s, (path, text) if text else path)
            best = after
        score, path = max(((s + chance(a, b, 0), p) for (a, b), (s, p) in best.items()), key=lambda e: e[0])
        out = []
        while path is not None:
            path, text = path
            out.append(text)
        return score, "".join(reversed(out))

    def decode(self, word: str) -> tuple[str, ...]:
        """The likeliest reading, split into words."""
        # doubled letters say little here: take the known word that differs in them only
        return tuple(w if w in self.known else self.bare.get(_DOUBLE.sub(r"\1", w), w) for w in self.likeliest(word)[1].split())


def features_of(word: str) -> tuple[str, ...]:
    """A word and its beginnings, which are marked by a star."""
    return (word, *[word[:n] + "*" for n in STEMS if len(word) > n])


def _words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, the words of all texts as places in that list, and each text's end."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts), r"[\t\n\v\f\r]", " ")
    lists = pc.split_pattern(spaced, " ")
    coded = lists.flatten().dictionary_encode()
    bounds = np.asarray(lists.offsets)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), bounds[1:] - bounds[0]


#: Letters, at least two, between punctuation that stands for no letter.
_PLAIN = "^[{}]*(\\p{{L}}{{2,}})[{}]*$".format(*(re.escape("".join(c for c in marks if c not in STANDS_FOR)) for marks in (_STRIP_START, _STRIP_END)))


def _plain_features(words: pa.Array, places: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are plain letters without a doubled one, and pairs ``word, feature`` of these by whole columns.

    Such a word reads as itself, so that :meth:`Restorer.told` would say the same of it.
    """
    cores = pc.struct_field(pc.extract_regex(words, _PLAIN.replace("(", "(?P<core>", 1)), [0])
    plain = pc.is_valid(cores).to_numpy(zero_copy_only=False).copy()
    at = np.flatnonzero(plain)
    cores = cores.drop_null()
    if len(at):
        letters = np.frombuffer("\n".join(cores.to_pylist()).encode("utf-32-le"), np.uint32)
        doubled = np.flatnonzero(letters[1:] == letters[:-1])
        plain[at[np.searchsorted(np.flatnonzero(letters == 10), doubled)]] = False
    keep = plain[at]
    at, cores = at[keep], cores.filter(pa.array(keep))
    names, numbers = pa.array(list(places), pa.string()), np.fromiter(places.values(), np.int64, len(places))
    size = pc.utf8_length(cores)
    ws, fs = [], []
    for n in (None, *STEMS):
        asked = cores if n is None else pc.if_else(pc.greater(size, n), pc.binary_join_element_wise(pc.utf8_slice_codeunits(cores, 0, n), "*", ""), None)
        found = pc.index_in(asked, value_set=names, skip_nulls=True)
        hit = np.flatnonzero(pc.is_valid(found).to_numpy(zero_copy_only=False))
        ws.append(at[hit])
        fs.append(numbers[found.drop_null().to_numpy().astype(np.int64)])
    return plain, np.concatenate(ws), np.concatenate(fs)


def _letter(word: str) -> str | None:
    """The letter or mark that a word is but for punctuation; None for other words, empty for punctuation alone."""
    bare = word.strip(_BETWEEN)
    if len(bare) > 1:
        bare = bare.rstrip(_STRIP_END).lstrip(_STRIP_START) or bare
    return bare if not bare or len(bare) == 1 and (bare.isalpha() or bare in STANDS_FOR) else None


def _kind(word: str) -> int:
    """The code point of the letter or mark that a word is, 0 for punctuation alone, -1 for other words."""
    letter = _letter(word)
    return -1 if letter is None else ord(letter) if letter else 0


def _spaced(words: list[str], codes: np.ndarray, ends: np.ndarray, kind: np.ndarray | None = None) -> list[tuple[int, str]]:
    """``(text, letters)`` of runs of single letters or marks standing alone, whatever spaces and punctuation are between.

    Runs are three and more with a letter among them, or four and more.
    """
    if not len(codes):
        return []
    if kind is None:
        kind = np.fromiter(map(_kind, words), np.int64, len(words))
    places = np.flatnonzero(kind[codes])  # without empty words and punctuation
    at = np.flatnonzero(kind[codes[places]] > 0)
    if not len(at):
        return []
    text = np.searchsorted(ends, places[at], side="right")
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(text) > 0)) + 1
    out = []
    for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])):
        if b - a >= 3:
            own = kind[codes[places[at[a:b]]]]
            own = own[np.concatenate([[True], own[1:] != own[:-1]]) | np.concatenate([[True, True], own[2:] != own[:-2]])]
            run = [chr(k) for k in own]
            if len(set(run)) > (1 if any(c.isalpha() for c in run) else 2) and (b - a > 3 or any(c.isalpha() for c in run)):
                out.append((int(text[a]), " ".join(run)))
    return out


def restored_words(texts: pa.Array, restorer: Restorer) -> list[set[str]]:
    """The distinct plain words of each text."""
    dictionary, codes, ends = _words_of(texts)
    words = dictionary.to_pylist()
    plain = [restorer.read(w) for w in words]
    out, s = [], 0
    for e in ends:
        out.append({x for i in np.unique(codes[s:e]) for x in plain[i]})
        s = e
    for text, letters in _spaced(words, codes, ends):
        out[text].update(restorer.read(letters))
    return out


def feature_hits(texts: pa.Array, restorer: Restorer, places: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs ``text, feature`` of what the texts hold."""
    words, codes, ends = _words_of(texts)
    plain, ws, fs = _plain_features(words, places)
    odd = np.flatnonzero(~plain)
    told = [restorer.told(w, places) for w in words.take(pa.array(odd)).to_pylist()]
    kind = np.full(len(words), -1)
    kind[odd] = [k for k, _ in told]
    ws = np.concatenate([ws, np.repeat(odd, [len(f) for _, f in told])]).astype(np.int64)
    fs = np.concatenate([fs, np.array([f for _, found in told for f in found], np.int64)])
    # each place of a word that tells something, with all that it tells
    many = np.bincount(ws, minlength=len(words))
    own = fs[np.argsort(ws, kind="stable")]
    at = np.flatnonzero(many[codes] > 0)
    times = many[codes[at]]
    first = (np.cumsum(many) - many)[codes[at]]
    rows = np.repeat(np.searchsorted(ends, at, side="right"), times).tolist()
    found = own[np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())].tolist()
    for t, letters in _spaced(words, codes, ends, kind):
        for x in restorer.read(letters):
            for f in features_of(x):
                if f in places:
                    rows.append(t)
                    found.append(places[f])
    size = max(places.values(), default=0) + 1
    pairs = np.unique(np.array(rows, np.int64) * size + np.array(found, np.int64))
    return pairs // size, pairs % size


def fit_logistic(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, size: int, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression on ``size`` features that are present at ``rows, columns``; the last weight is the bias.

    Newton steps, each solved by conjugate gradients: memory is that of the present pairs.
    """
    w = np.zeros(size + 1)
    penalty = np.full(size + 1, ridge)
    penalty[-1] = 1e-3
    ahead = lambda v: np.bincount(rows, v[columns], len(y)) + v[-1]
    back = lambda v: np.append(np.bincount(columns, v[rows], size), v.sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(ahead(w), -30, 30)))
        curve = p * (1 - p)
        rest = -(back(p - y) + penalty * w)
        diagonal = back(curve) + penalty
        step, turn = np.zeros(size + 1), rest / diagonal
        now, least = rest @ turn, 1e-12 * (rest @ (rest / diagonal))
        for _ in range(4 * (size + 1)):
            if now <= least:
                break
            along = back(curve * ahead(turn)) + penalty * turn
            by = now / (turn @ along)
            step += by * turn
            rest = rest - by * along
            old, now = now, rest @ (rest / diagonal)
            turn = rest / diagonal + now / old * turn
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, toxic`` of labelled rows outside the held-out fold.

    About ``train_rows`` of each class at most: of a larger class, those whose id's hash is in
    that share of its range. Near copies would make every word of theirs look telling, so of
    rows that share a minimum over two hashes of their five-word shingles one is kept.
    """
    y = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    )
    size = {r["toxic"]: r["n"] for r in y.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).where("toxic in (0, 1)").collect()}
    share = lambda t: min(1.0, train_rows / max(size.get(t, 0), 1))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / float(1 << 32)
    chosen = y.where((F.col("toxic").isin(0, 1)) & (place < F.when(F.col("toxic") == 1, share(1)).otherwise(share(0)))).select(
        F.col("doc_id").alias("y_id"), "toxic"
    )
    rows = materialise(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("y_id"))  # about twice train_rows ids at most
        .select("doc_id", "text", "toxic"),
        "labelled",
    )
    least = (
        shingle_hashes(rows, ["doc_id"], "text", 5)
        .groupBy(F.col("doc_id").alias("l_id"))
        .agg(F.min("h").alias("m1"), F.min(F.xxhash64("h")).alias("m2"))
    )
    kept = rows.join(least, F.col("doc_id") == F.col("l_id"))
    for m in ("m1", "m2"):
        first = kept.groupBy(F.col(m).alias("f"), F.col("toxic").alias("f_toxic")).agg(F.min("doc_id").alias("f_id"))
        kept = kept.join(
            first, (F.col(m) == F.col("f")) & (F.col("toxic") == F.col("f_toxic")) & (F.col("doc_id") == F.col("f_id"))
        ).drop("f", "f_toxic", "f_id")
    return kept.select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[LanguageModel, list[str], np.ndarray]:
    """The language model, the classifier's words and their weights (bias last).

    Every word and beginning of a word of the training rows that tells more than chance is
    weighed; what comes to the driver is bounded by the training rows, not by the corpus.
    """
    model = language_model(docs)
    train = materialise(training_rows(docs, labels, train_rows), "train")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for a, b in _slices(texts):
                sets = restored_words(texts.slice(a, b - a), restorer)
                y = batch.column("toxic").slice(a, b - a).to_pylist()
                flat = [(f, t) for s, t in zip(sets, y) for f in {f for w in s for f in features_of(w)}]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in flat], pa.string()), pa.array([t for _, t in flat], pa.int32())], ["word", "toxic"]
                )

    size = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    yes, no = size.get(1, 0), size.get(0, 0)
    if not yes or not no:
        return model, [], np.array([-30.0 if not yes else 30.0])
    counted = (
        train.select("text", F.col("toxic").cast("int").alias("toxic"))
        .mapInArrow(words, "word string, toxic int")
        .groupBy("word")
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        .where(F.col("a") * no >= LIFT * F.col("b") * yes)
    )
    # twice the log likelihood ratio of the word's presence and the label
    held, all_ = F.col("a") + F.col("b"), yes + no
    cells = [
        (F.col("a"), held * yes / all_),
        (F.col("b"), held * no / all_),
        (yes - F.col("a"), (all_ - held) * yes / all_),
        (no - F.col("b"), (all_ - held) * no / all_),
    ]
    ratio = sum(F.when(n > 0, n * F.log(n / expected)).otherwise(0.0) for n, expected in cells)
    told = {r["word"]: (r["a"], r["b"]) for r in counted.where(2 * ratio >= SIGNIFICANCE).collect()}
    # a beginning in just the rows of a longer feature tells no more than that one
    longer = {(f, told[w]) for w in told for f in features_of(w.rstrip("*"))[1:] if f != w}
    names = sorted(w for w in told if (w, told[w]) not in longer)
    places = {w: i for i, w in enumerate(names)}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model, frozenset(n for n in names if n[-1] != "*"))
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for a, b in _slices(texts):
                rows, found = feature_hits(texts.slice(a, b - a), restorer, places)
                own = [found[rows == i].tolist() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("toxic").slice(a, b - a), pa.array(own, pa.list_(pa.int64()))],
                    ["doc_id", "toxic", "found"],
                )

    rows = (
        train.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
        .mapInArrow(hits, "doc_id long, toxic int, found array<long>")
        .orderBy("doc_id", "toxic", "found")
        .collect()
    )
    present = np.repeat(np.arange(len(rows)), [len(r["found"]) for r in rows])
    found = np.array([f for r in rows for f in r["found"]], np.int64)
    return model, names, fit_logistic(present, found, np.array([r["toxic"] for r in rows], float), len(names))


def score(docs: DataFrame, fitted: tuple[LanguageModel, list[str], np.ndarray]) -> DataFrame:
    """``doc_id, th, score`` of every row; ``th`` is the text's hash."""
    model, names, weights = fitted
    places = {w: i for i, w in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model, frozenset(n for n in names if n[-1] != "*"))
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for a, b in _slices(texts):
                rows, found = feature_hits(texts.slice(a, b - a), restorer, places)
                z = np.full(b - a, weights[-1])
                np.add.at(z, rows, weights[found])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("th").slice(a, b - a),
                        pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))),
                    ],
                    ["doc_id", "th", "score"],
                )
        pa.default_memory_pool().release_unused()  # the worker lives on with other stages

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text"
    ).mapInArrow(run, "doc_id long, th long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    The classifier learns from labelled rows whose ``crc32(doc_id) mod 5`` is not 0, the
    character model from all texts. A score depends on the text only. A null or empty text
    gets the score of a text without any weighed word. Labels that are null or lack an id are
    ignored; repeated labels of an id count as toxic if any is. Without labels of both
    classes every score is the one class's (0 without labels). A null id is not held out.
    Repeated rows get equal scores; an empty table gives no rows. A very long text is scored whole by
    one task, which holds its words.
    """
    out = score(docs, fit(docs, labels, train_rows))
    return out.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more.

    Nulls, labels and long texts are read as by :func:`score_documents`. Rows of one id and text go or
    stay together, those of a null id among them. An empty table gives no rows.
    """
    b_id, b_th = fresh(docs, "b_id", "b_th")
    bad = (
        score(docs, fit(docs, labels, train_rows))
        .where("score >= 0.5")
        .select(F.coalesce("doc_id", F.lit(NO_ID)).alias(b_id), F.col("th").alias(b_th))
        .distinct()
    )
    return docs.join(
        bad,
        (F.coalesce(F.col("doc_id"), F.lit(NO_ID)) == F.col(b_id))
        & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(b_th)),
        "left_anti",
    )
