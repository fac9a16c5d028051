"""Phrase collocations by prefix-free parsing.

Texts are cut into chunks at places that two neighbouring words choose by their hash, so that equal
passages are cut alike wherever they stand. A chunk owns the words up to the next cut and carries those
that a phrase starting in it may still need; these overlap with the next chunk, which owns them. Equal
chunks become one entry of a dictionary with its frequency in the parse, and phrases are counted inside
distinct chunks, weighted, each where it starts in owned words and so once.

A phrase can only be frequent if the two that are a word shorter are. So words, and then phrases of two
frequent words, are first counted by short hashes alone, as most of them are rare and need not travel as
texts. What is frequent by its hash goes out as a filter of bounded size, which may let others through and
never stops one; what passes, and all longer phrases, are then counted by their texts, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm import common
from fleetgauge.llm.common import KeyFilter, attach

#: A-Z in lower case, tabs as blanks, and the signs that end a piece as line ends.
_PLAIN = bytes(
    10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_SLICE = 4 << 20
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def stored(df: DataFrame, label: str) -> DataFrame:
    """As ``common.stored``, packed closer: the dictionary has nearly all of the text and stays to the end."""
    return common.stored(df, label, "zstd")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of all its words but the last, and of its last word."""
    return _mixed(left * _STEP + right)


def _short(hashes: np.ndarray) -> np.ndarray:
    """The 40 bits that phrases are first counted by: a shuffled row takes a quarter less than with all 64."""
    return hashes >> np.uint64(24)


def _spread(short: np.ndarray) -> np.ndarray:
    """A filter's 64-bit key of a short hash."""
    return _mixed((short + np.uint64(1)) * _STEP)


class Words:
    """The words of some plain texts: where they stand, their piece and their text."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts)
        self.raw = joined
        data = np.frombuffer(joined, np.uint8)
        inside = (data != 32) & (data != 10)
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        line_ends = np.flatnonzero(data == 10)
        self.piece = np.searchsorted(line_ends, self.starts)
        self.text_starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) if texts else np.zeros(0, np.int64)
        self.text = np.searchsorted(self.text_starts, self.starts, side="right") - 1
        self.letters = data[inside]
        self.offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)])

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        if not len(self):
            return np.empty(0, np.uint64)
        lengths = self.ends - self.starts
        at = np.arange(len(self.letters)) - np.repeat(self.offsets[:-1], lengths)
        powers = np.cumprod(np.full(int(lengths.max()), _BASE))
        return _mixed(np.add.reduceat((self.letters + np.uint64(1)) * powers[at], self.offsets[:-1]))

    def strings(self) -> pa.Array:
        buffers = [None, pa.py_buffer(self.offsets.astype(np.int64)), pa.py_buffer(self.letters)]
        return pa.LargeStringArray.from_buffers(len(self), buffers[1], buffers[2])


def _slices(sizes: np.ndarray, most: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with about ``most`` bytes each, one row at least."""
    group = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    yield from ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def chunk_bounds(words: Words, longest: int, every: int, own_most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First owned, first no longer owned, and first no longer carried word of each chunk.

    A cut falls where two neighbouring words' hashes say so, about ``every`` words, at each text's start,
    and after ``own_most`` words without one.
    """
    n = len(words)
    if not n:
        return (np.empty(0, np.int64),) * 3
    h = words.hashes()
    cut = np.ones(n, bool)
    cut[1:] = (_joined_hash(h[:-1], h[1:]) % np.uint64(every) == 0) | (words.text[1:] != words.text[:-1])
    first = np.flatnonzero(cut)
    gaps = np.diff(np.append(first, n))
    parts = -(-gaps // own_most)
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(first, parts) + within * own_most
    end = np.append(first[1:], n)
    carried = end.copy()
    for j in range(longest - 1):
        at = np.minimum(end + j, n - 1)
        carried += (end + j < n) & (words.piece[at] == words.piece[end - 1])
    return first, end, carried


def chunk_dictionary(docs: DataFrame, longest: int = 5, every: int = 24, own_most: int = 256) -> DataFrame:
    """lang, chunk, owned, copies: the distinct chunks of all texts and how often the parse has them."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for a, b in _slices(_sizes(batch.column(1))):
                texts = [t.encode().translate(_PLAIN) for t in batch.column(1).slice(a, b - a).to_pylist()]
                words = Words(texts)
                first, end, carried = chunk_bounds(words, longest, every, own_most)
                raw = words.raw
                spans = zip(words.starts[first].tolist(), words.ends[carried - 1].tolist())
                chunks = pa.array([raw[x:y] for x, y in spans], pa.binary()).cast(pa.string())
                langs = batch.column(0).take(pa.array(words.text[first] + a))
                yield pa.record_batch(
                    [langs, chunks, pa.array((end - first).astype(np.int32))], names=["lang", "chunk", "owned"]
                )

    given = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    cut = given.mapInArrow(parse, "lang string, chunk string, owned int")
    return stored(cut.groupBy("lang", "chunk", "owned").agg(F.count(F.lit(1)).alias("copies")), "phrase-chunks")


class _Phrases:
    """Positions of some chunks' words where a phrase of the current length starts that may be frequent.

    ``spelled``: with the texts of the phrases, not with their hashes only.
    """

    def __init__(self, batch: pa.RecordBatch, frequent: KeyFilter | None, spelled: bool):
        chunks = [c.encode() for c in batch.column(1).to_pylist()]
        words = Words(chunks)
        self.piece = words.piece
        strings = pc.dictionary_encode(words.strings())
        langs = pc.dictionary_encode(batch.column(0))
        names = len(strings.dictionary)
        lang = langs.indices.to_numpy()[words.text].astype(np.int64)
        self.word, pairs = pd.factorize(lang * names + strings.indices.to_numpy())
        tongue = pairs // names
        self.langs = langs.dictionary.take(pa.array(tongue))
        self.words = strings.dictionary.take(pa.array(pairs % names)).cast(pa.string()) if spelled else None
        seen = np.empty(len(pairs), np.int64)
        seen[self.word] = np.arange(len(self.word))
        # A word's hash and its language's: the same words of another language are other phrases.
        own = words.hashes()[seen]
        spelled_langs = (x.encode().replace(b" ", b"_").replace(b"\n", b"_") or b"_" for x in langs.dictionary.to_pylist())
        self.hash = _joined_hash(Words(list(spelled_langs)).hashes()[tongue], own)
        ordinal = np.arange(len(words)) - np.searchsorted(words.starts, words.text_starts)[words.text]
        owned = batch.column(2).to_numpy()[words.text]
        self.weight = np.where(ordinal < owned, batch.column(3).to_numpy()[words.text], 0)
        self.length = 1
        self.at = np.arange(len(words))
        self.id, self.phrase_hash = self.word, self.hash
        self.first = self._kept(np.arange(len(pairs)), frequent)[0]
        self.texts = self.words.take(pa.array(self.first)) if spelled else None

    def _kept(self, which: np.ndarray, frequent: KeyFilter | None) -> tuple[np.ndarray, np.ndarray]:
        """``which`` of the phrases that the filter holds, and their numbers; the others and their places go."""
        if frequent is None:
            return which, np.arange(len(which))
        known = frequent.may_hold(_spread(_short(self.phrase_hash)))
        on = known[self.id]
        self.at, self.id = self.at[on], (np.cumsum(known) - 1)[self.id[on]]
        self.phrase_hash = self.phrase_hash[known]
        return which[known], np.flatnonzero(known)

    def extend(self, frequent: KeyFilter | None) -> None:
        """Phrases one word longer, where both that are a word shorter are left, and those the filter holds."""
        ids = np.full(len(self.word) + 1, -1, np.int64)
        ids[self.at] = self.id
        last = self.at + self.length
        fits = last < len(self.word)
        at, left, last = self.at[fits], self.id[fits], last[fits]
        same = (ids[at + 1] >= 0) & (self.piece[last] == self.piece[at])
        at, left, right = at[same], left[same], self.word[last[same]]
        self.id, pairs = pd.factorize(left * np.int64(len(self.hash)) + right)
        left, right = pairs // len(self.hash), pairs % len(self.hash)
        self.at, self.length = at, self.length + 1
        self.phrase_hash = _joined_hash(self.phrase_hash[left], self.hash[right])
        left, kept = self._kept(left, frequent)
        if self.words is not None:
            ends = self.words.take(pa.array(right[kept]))
            self.texts = pc.binary_join_element_wise(self.texts.take(pa.array(left)), ends, " ")
        self.first = self.first[left]

    def _counted(self) -> tuple[np.ndarray, np.ndarray]:
        n = np.bincount(self.id, self.weight[self.at], minlength=len(self.first)).astype(np.int64)
        some = np.flatnonzero(n)
        return some, n[some]

    def sums(self) -> pa.RecordBatch:
        some, n = self._counted()
        short = _short(self.phrase_hash[some])
        return pa.record_batch([pa.array(short.view(np.int64)), pa.array(n)], names=["hash", "a"])

    def counts(self) -> pa.RecordBatch:
        some, n = self._counted()
        langs = self.langs.take(pa.array(self.first[some])).cast(pa.string())
        texts = pc.binary_join_element_wise(langs, self.texts.take(pa.array(some)).cast(pa.string()), "\n")
        return pa.record_batch([texts, pa.array(n)], names=["spoken", "a"])


def _fewer(dictionary: DataFrame, chunks: int) -> DataFrame:
    """In tasks of some ``chunks`` rows, two a core at least: what is frequent travels once for each task."""
    tasks = -(-dictionary.count() // chunks)
    return dictionary.coalesce(max(tasks, 2 * dictionary.sparkSession.sparkContext.defaultParallelism))


def frequent_phrases(dictionary: DataFrame, longest: int = 5, least: int = 100) -> DataFrame:
    """lang, phrase, size, a: phrases of 1 to ``longest`` words that occur ``least`` times or more."""
    filters: list[KeyFilter] = []

    def counter(sizes: range):
        """Sums by hash of one size, or counts of texts of all sizes from 1."""
        spelled = len(sizes) > 1 or longest == 1

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [*filters, *[None] * (sizes[-1] - len(filters))]
            for batch in batches:
                if not batch.num_rows:
                    continue
                for a, b in _slices(_sizes(batch.column(1))):
                    phrases = _Phrases(batch.slice(a, b - a), held[0], spelled)
                    for size in range(1, sizes[-1] + 1):
                        if size > 1:
                            phrases.extend(held[size - 1])
                        if size in sizes:
                            yield phrases.counts() if spelled else phrases.sums()

        return count

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = batch.column(0).to_numpy().view(np.uint64)
            yield pa.record_batch([pa.array(_spread(short).view(np.int64))], names=["key"])

    # Few phrases of three words are left to count, and the longer ones lie within them, so that reading
    # the dictionary once more would cost more than counting those that a further filter would drop.
    for size in range(1, min(longest, 3)):
        each = _fewer(dictionary, 200_000).mapInArrow(counter(range(size, size + 1)), "hash long, a long")
        # Phrases of one hash are counted together, and none of them is more frequent than their sum.
        total = each.groupBy("hash").agg(F.sum("a").alias("a"))
        kept = stored(total.filter(F.col("a") >= least).select("hash"), f"phrase-hashes-{size}")
        filters = [*filters, KeyFilter.of(kept.mapInArrow(keys, "key long"))]
    # Language and phrase travel as one text; a phrase has no line end, so the last one divides them.
    each = _fewer(dictionary, 400_000).mapInArrow(counter(range(1, longest + 1)), "spoken string, a long")
    total = each.groupBy("spoken").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    phrase = F.substring_index("spoken", "\n", -1)
    lang = F.expr("left(spoken, length(spoken) - length(phrase) - 1)")
    found = total.withColumn("phrase", phrase).select(lang.alias("lang"), "phrase", "a", F.size(F.split("phrase", " ")).alias("size"))
    found = stored(found, "phrases")
    for filter_ in filters:
        filter_.free()
    return found


def collocations(
    docs: DataFrame, longest: int = 5, least: int = 100, share: int = 100, top: int = 2000, every: int = 24
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words.

    ``docs`` has lang (null: und) and text (null: empty). A-Z is lower-cased; pieces end at ``.,;:!?`` and
    line ends, words at blanks and tabs; words are counted and phrases found within pieces. ``n`` counts
    the language's words, ``a`` the phrase (``least`` times or more). Cut after k words, l and r count its
    parts, and the score is floor(1000 a n / (l r)), the lowest of all cuts (ties: smallest k), in decimals
    of 38 digits. A phrase goes if a longer one of at most ``longest`` words contains it and has at least
    ``share`` percent of its count. Ranks go by score, then a, both falling, then the phrase's bytes.

    Repeated rows count each; very long texts are chunked as all are, in memory in proportion to the
    longest; other columns aren't read; an empty table, or one without frequent phrases, gives no rows.
    """
    dictionary = chunk_dictionary(docs, longest, every)
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("owned") * F.col("copies")).alias("n"))
    known = frequent_phrases(dictionary, longest, least)
    candidates = known.filter("size > 1")
    words = F.split("phrase", " ")

    def part(from_, size):
        return F.struct("lang", F.array_join(F.slice("words", from_, size), " ").alias("phrase"))

    cuts = candidates.withColumn("words", words).withColumn(
        "k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    )
    sides = cuts.withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    key = F.struct("lang", "phrase")
    for side, count in (("left", "l"), ("right", "r")):
        sides = attach(sides, known.select(key.alias(side), F.col("a").alias(count)), side, "phrase", salts=8)
    sides = attach(sides, totals, "lang", "phrase")
    wide = {c: F.col(c).cast("decimal(38,0)").alias(c) for c in ("a", "n", "l", "r")}
    score = (
        sides.select("lang", "phrase", "k", "a", "n", "l", "r", *[c.alias(f"w_{n}") for n, c in wide.items()])
        .withColumn("score", F.expr("(1000 * w_a * w_n) div (w_l * w_r)"))
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("v"))
        .select("lang", "phrase", "v.a", "v.l", "v.r", "v.n", "v.score")
    )
    # A phrase inside one that is two words longer is inside one that is a word longer and no rarer.
    inside = F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))
    longer = (
        candidates.filter("size > 2")
        .withColumn("words", words)
        .select(F.explode(inside).alias("held"), "a")
        .groupBy("held")
        .agg(F.max("a").alias("longer"))
    )
    both = score.withColumn("held", key).join(longer, "held", "left")
    open_ = both.filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = open_.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
