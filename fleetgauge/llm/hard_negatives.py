"""Hard negatives: rows of another label that score close below an anchor's positives.

Vectors become integers and scores are integer inner products. Each vector is rotated and described by
one-bit codes: the signs of the rotated vector, then the signs of what the first code leaves over, and so
on. With each code its alignment with what it describes is stored, and with the last the length of the
rest. An anchor is rotated too and rounded to a few bits a component, so that its product with a code
is a sum of popcounts over bit planes. Alignments times these products estimate the score; the rounding's
length and, by Cauchy and Schwarz, the rest's length bound the error for certain. Only rows whose interval
reaches the scores that are still wanted are scored, so the result is that of comparing all.

The codes are written once and read in place: anchors, a stated share of all rows, go out in blocks of a
fixed number, and each task keeps the few best of each. Nothing but those few is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import stored
from fleetgauge.sources.scratch import fresh_path

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_NEVER = np.iinfo(np.int64).min


class Codes:
    """One-bit codes of rotated vectors, and bounds of inner products from them."""

    def __init__(self, dims: int, levels: int, bits: int, seed: int = 12):
        self.dims, self.levels, self.bits = dims, levels, bits
        self.words = -(-dims // 64)
        self.turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))[0]

    def _packed(self, marks: np.ndarray) -> np.ndarray:
        bits = np.zeros((*marks.shape[:-1], self.words * 64), np.uint8)
        bits[..., : self.dims] = marks
        return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, levels, words), and per row the alignments, the rest's length and the own length."""
        rest = vectors.astype(np.float64) @ self.turn
        codes = np.empty((len(rest), self.levels, self.words), np.uint64)
        facts = np.empty((len(rest), self.levels + 2))
        facts[:, -1] = np.linalg.norm(rest, axis=1)
        for level in range(self.levels):
            marks = rest >= 0
            aligned = np.abs(rest).sum(axis=1) / self.dims**0.5
            codes[:, level], facts[:, level] = self._packed(marks), aligned
            rest = rest - np.where(marks, 1.0, -1.0) * (aligned / self.dims**0.5)[:, None]
        facts[:, -2] = np.linalg.norm(rest, axis=1)
        return codes, facts

    def asked(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """Anchors rounded to ``bits`` a component, as bit planes, with what bounds need of them."""
        turned = vectors.astype(np.float64) @ self.turn
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / (2**self.bits - 1), np.finfo(float).tiny)
        whole = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
        rounded = low[:, None] + whole * step[:, None]
        off = turned - rounded
        return {
            "planes": np.stack([self._packed(whole >> j & 1) for j in range(self.bits)], axis=1),
            "low": low,
            "step": step,
            "total": rounded.sum(axis=1),
            "off": np.minimum(np.linalg.norm(off, axis=1), np.abs(off).sum(axis=1) / self.dims**0.5),
            "length": np.linalg.norm(turned, axis=1),
        }

    def interval(self, asked: dict, k: int, codes: np.ndarray, ones: np.ndarray, facts: np.ndarray):
        """Certain lower and upper bounds of anchor k's product with each row."""
        estimate, error = np.zeros(len(codes)), np.zeros(len(codes))
        for level in range(self.levels):
            counted = np.zeros(len(codes))
            for j, plane in enumerate(asked["planes"][k]):
                both = np.bitwise_count(codes[:, level] & plane)
                counted += both.sum(axis=1, dtype=np.int64) * float(1 << j) if self.words > 1 else both[:, 0] * float(1 << j)
            half = asked["low"][k] * ones[:, level] + asked["step"][k] * counted
            met = (2 * half - asked["total"][k]) / self.dims**0.5
            estimate += facts[:, level] * met
            error += facts[:, level]
        error *= asked["off"][k]
        # The rest stands upright on the last code, so only the anchor's part beside that code meets it.
        along = np.maximum(np.abs(met) - asked["off"][k], 0)
        error += facts[:, -2] * np.sqrt(np.maximum(asked["length"][k] ** 2 - along**2, 0))
        error += 1e-9 * asked["length"][k] * facts[:, -1] + 1e-6
        return estimate - error, estimate + error


def _index(rows: DataFrame, codes: Codes) -> DataFrame:
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made, facts = codes.encode(_matrix(batch.column(2), codes.dims))
            yield pa.record_batch(
                [
                    *batch.columns,
                    pa.array([x.tobytes() for x in made], pa.binary()),
                    pa.array([x.tobytes() for x in facts], pa.binary()),
                ],
                names=["vec_id", "label", "vec", "codes", "facts"],
            )

    return stored(
        rows.mapInArrow(encoded, "vec_id long, label long, vec array<long>, codes binary, facts binary"), "one-bit-codes"
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def _bytes(column: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class _Best:
    """The k best (score, id) of one list so far, ties to the smaller id."""

    __slots__ = ("ids", "scores", "k")

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """A lower score can't enter any more."""
        return int(self.scores[-1]) if len(self.scores) == self.k else _NEVER

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        top = _top(ids, scores, self.k)
        self.ids, self.scores = ids[top], scores[top]


def _pieces(codes: Codes, batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        if not batch.num_rows:
            continue
        made = _bytes(batch.column(3), np.uint64, (codes.levels, codes.words))
        yield (
            batch.column(0).to_numpy(),
            batch.column(1).to_numpy(),
            _matrix(batch.column(2), codes.dims),
            made,
            np.bitwise_count(made).sum(axis=2, dtype=np.int64),
            _bytes(batch.column(4), np.float64, (codes.levels + 2,)),
        )


def _positives(codes: Codes, anchors, k: int):
    """Per task the k best rows of each anchor's own label."""

    def search(batches):
        ids, labels, vectors = anchors.value
        asked = codes.asked(vectors)
        best = [_Best(k) for _ in ids]
        for their, label, matrix, made, ones, facts in _pieces(codes, batches):
            for name in np.intersect1d(label, labels):
                own = np.flatnonzero(label == name)
                part = [x[own] for x in (their, matrix, made, ones, facts)]
                for a in np.flatnonzero(labels == name):
                    _, upper = codes.interval(asked, a, *part[2:])
                    near = np.flatnonzero((upper >= best[a].least) & (part[0] != ids[a]))
                    if len(near):
                        best[a].add(part[0][near], part[1][near] @ vectors[a])
        for a, held in enumerate(best):
            if len(held.ids):
                yield pa.record_batch(
                    [pa.array(np.full(len(held.ids), ids[a])), pa.array(held.ids), pa.array(held.scores)],
                    names=["anchor_id", "positive_id", "positive_score"],
                )

    return search


def _negatives(codes: Codes, anchors, k: int, least: int, most: int):
    """Per task the k best rows of other labels in the window below each positive."""

    def search(batches):
        ids, labels, vectors, windows = anchors.value
        asked = codes.asked(vectors)
        # Of positive p the window is least * p <= 100 * score <= most * p, in whole scores.
        open_ = {
            a: [(p, s, -(-least * s // 100), most * s // 100, _Best(k)) for p, s in found]
            for a, found in enumerate(windows)
        }
        open_ = {a: [w for w in ws if w[2] <= w[3]] for a, ws in open_.items()}
        for their, label, matrix, made, ones, facts in _pieces(codes, batches):
            for a, ws in open_.items():
                if not ws:
                    continue
                from_ = min(max(w[2], w[4].least) for w in ws)
                to = max(w[3] for w in ws)
                lower, upper = codes.interval(asked, a, made, ones, facts)
                near = np.flatnonzero((upper >= from_) & (lower <= to) & (label != labels[a]))
                if not len(near):
                    continue
                scores = matrix[near] @ vectors[a]
                for _, _, low, high, best in ws:
                    fits = (scores >= max(low, best.least)) & (scores <= high)
                    if fits.any():
                        best.add(their[near][fits], scores[fits])
        for a, ws in open_.items():
            for positive, score, _, _, best in ws:
                n = len(best.ids)
                if n:
                    yield pa.record_batch(
                        [
                            pa.array(np.full(n, ids[a])),
                            pa.array(np.full(n, positive)),
                            pa.array(best.ids),
                            pa.array(np.full(n, score)),
                            pa.array(best.scores),
                        ],
                        names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"],
                    )

    return search


def usable_rows(rows: DataFrame, scale: float = 256.0) -> tuple[DataFrame, int]:
    """vec_id, label, vec (floors of the scaled components) of the rows that take part, and their dimension."""
    numbers = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.transform(F.col("embedding").cast("array<double>"), lambda x: x * scale).alias("x"),
    )
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = numbers.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    sound = sound.filter(F.size("x") > 0)
    shapes = sound.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = shapes.dims if shapes else 0
    largest = float(int((2**62 / max(dims, 1)) ** 0.5))
    fitting = sound.filter((F.size("x") == dims) & F.forall("x", lambda x: F.abs(x) < largest))
    whole = fitting.select("vec_id", "label", F.transform("x", lambda x: F.floor(x)).alias("vec"))
    first = F.min(F.struct("label", "vec")).alias("first")
    return whole.groupBy("vec_id").agg(first).select("vec_id", "first.label", "first.vec"), dims


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    levels: int = 3,
    bits: int = 6,
    block: int = 8192,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and embedding; rows where ``anchors`` holds (an expression of vec_id) are
    anchors. An anchor's positives are the ``positives`` best other rows of its label; for each of them
    the ``negatives`` best rows of other labels with least * positive_score <= 100 * negative_score <=
    most * positive_score come back. Higher scores come first, ties go to the smaller id.

    Rows with a null id, label, vector or component, or one that isn't finite, take no part, nor do empty
    vectors, vectors whose length differs from most, and such whose scaled components may pass a 64-bit
    score together (2^28 for 64 components). Rows that repeat an id are one, the first by label and
    vector. Zero vectors score 0. Further columns aren't read; an empty table gives no rows.

    Each block of about ``block`` anchors is read twice against all codes, so the work is that of all
    anchors with all rows, as the task asks; memory is bounded by the block and the batch of rows.
    """
    spark = rows.sparkSession
    clean, dims = usable_rows(rows)
    if not dims:
        return spark.createDataFrame([], RESULT)
    codes = Codes(dims, levels, bits)
    index = _index(clean, codes)
    asked = index.filter(anchors).select("vec_id", "label", "vec")
    blocks = max(1, -(-asked.count() // block))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    path = fresh_path(spark, "anchors")
    dealt.write.partitionBy("block").parquet(path)
    found = fresh_path(spark, "hard-negatives")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    hard = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    names = [part.split()[0] for part in RESULT.split(", ")]
    for k in range(blocks):
        here = spark.read.schema(dealt.schema).parquet(path).filter(F.col("block") == k).toArrow()
        ids, labels = here["vec_id"].to_numpy(), here["label"].to_numpy()
        vectors = here["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
        sent = spark.sparkContext.broadcast((ids, labels, vectors))
        near = index.mapInArrow(_positives(codes, sent, positives), "anchor_id long, positive_id long, positive_score long")
        near = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives).toArrow()
        of = {a: [] for a in ids.tolist()}
        for a, p, s in zip(*(near[c].to_pylist() for c in ("anchor_id", "positive_id", "positive_score"))):
            of[a].append((p, s))
        sent.destroy()
        sent = spark.sparkContext.broadcast((ids, labels, vectors, [of[a] for a in ids.tolist()]))
        rows_ = index.mapInArrow(
            _negatives(codes, sent, negatives, least, most),
            "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long",
        )
        ranked = rows_.withColumn("rank", F.row_number().over(hard).cast("int")).filter(F.col("rank") <= negatives)
        ranked.select(names).write.parquet(f"{found}/block={k}")
        sent.destroy()
    return spark.read.schema(RESULT).parquet(found).select(names)
