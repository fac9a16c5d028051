"""Quality score by a convolutional network over the bytes of a text.

Each byte is a learned vector; one more channel says whether the four bytes at this place also stood
a little earlier, which tells repetition from prose. Filters run over overlapping chunks that cover
the whole text, each filter keeps its largest answer, and a logistic unit combines them into one
probability. The network is fitted in numpy on a bounded sample of labelled rows and is small; all
texts are scored where they lie, block by block, so memory doesn't grow with a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

WIDTH, STEP = 16, 8
LAGS = range(2, 41)
BLOCK = 1 << 16


def echoes(data: np.ndarray) -> np.ndarray:
    """1 where the four bytes from here on also begin 2 to 40 bytes earlier."""
    found = np.zeros(len(data), bool)
    if len(data) >= 4:
        wide = data.astype(np.uint32)
        four = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
        for lag in LAGS:
            if lag < len(four):
                found[lag : len(four)] |= four[lag:] == four[:-lag]
    return found


@dataclass
class Network:
    bytes_: np.ndarray  # 256 x vector
    echo: np.ndarray  # the channel's own vector
    filters: np.ndarray  # WIDTH * vector x filters
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def windows(self, data: np.ndarray, echo: np.ndarray) -> np.ndarray:
        """The vectors of the chunks that begin at every STEP-th byte, the end padded with zeros."""
        chunks = max(1, -(-max(0, len(data) - WIDTH) // STEP) + 1)
        size = self.bytes_.shape[1]
        wide = np.zeros((STEP * (chunks - 1) + WIDTH, size), np.float32)
        wide[: len(data)] = self.bytes_[data] + echo[:, None] * self.echo
        flat = wide.ravel()
        return np.lib.stride_tricks.as_strided(
            flat, (chunks, WIDTH * size), (STEP * size * flat.itemsize, flat.itemsize)
        )

    def answers(self, data: np.ndarray) -> np.ndarray:
        """Each filter's largest answer over the whole text."""
        best = np.full(len(self.bias), -np.inf, np.float32)
        for at in range(0, max(1, len(data)), BLOCK):
            before = max(0, at - max(LAGS))
            part = data[before : at + BLOCK + WIDTH]
            echo = echoes(part)[at - before :]
            best = np.maximum(best, (self.windows(part[at - before :], echo) @ self.filters).max(axis=0))
        return np.maximum(best + self.bias, 0)

    def score(self, text: str) -> float:
        data = np.frombuffer(text.encode(), np.uint8)
        logit = float(self.answers(data) @ self.weights) + self.offset
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60)))


def constant(probability: float, vector: int = 8, filters: int = 1) -> Network:
    """What is used where the labels hold a single class or none."""
    p = min(max(probability, 0.001), 0.999)
    zero = np.zeros
    return Network(
        zeros := zero((256, vector), np.float32),
        zeros[0],
        zero((WIDTH * vector, filters), np.float32),
        zero(filters, np.float32),
        zero(filters, np.float32),
        float(np.log(p / (1 - p))),
    )


def fit(
    texts: list[str], labels: list[int], prior: float, filters: int = 32, vector: int = 8, epochs: int = 10
) -> Network:
    """Adam on the logistic loss; the gradient of a filter flows through the chunk that answered most.

    ``prior`` is the share of label 1 among all labelled rows, of which the sample may differ.
    """
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return constant(prior)
    rng = np.random.default_rng(5)
    net = Network(
        rng.normal(0, 0.5, (256, vector)).astype(np.float32),
        rng.normal(0, 0.5, vector).astype(np.float32),
        rng.normal(0, (WIDTH * vector) ** -0.5, (WIDTH * vector, filters)).astype(np.float32),
        np.zeros(filters, np.float32),
        rng.normal(0, filters**-0.5, filters).astype(np.float32),
        0.0,
    )
    data = [np.frombuffer(x.encode(), np.uint8) for x in texts]
    echo = [echoes(d).astype(np.float32) for d in data]
    names = ["bytes_", "echo", "filters", "bias", "weights", "offset"]
    first = {k: np.zeros_like(np.asarray(getattr(net, k), np.float32)) for k in names}
    second = {k: v.copy() for k, v in first.items()}
    step, batch, rate = 0, 16, 0.01
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            pooled = np.zeros((len(rows), filters), np.float32)
            chosen, taken = [], []
            for r, k in enumerate(rows):
                seen = net.windows(data[k], echo[k])
                answers = seen @ net.filters
                best = answers.argmax(axis=0)
                pooled[r] = answers[best, np.arange(filters)] + net.bias
                chosen.append(best)
                taken.append(seen[best])  # filters x WIDTH * vector
            active = pooled > 0
            hidden = np.where(active, pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.weights + net.offset, -30, 30)))
            error = (p - y[rows]) / len(rows)
            back = error[:, None] * net.weights * active
            grad = {
                "weights": hidden.T @ error + 1e-4 * net.weights,
                "offset": np.float32(error.sum()),
                "bias": back.sum(axis=0),
                "filters": np.einsum("rf,rfd->df", back, np.stack(taken)),
                "bytes_": np.zeros_like(net.bytes_),
                "echo": np.zeros_like(net.echo),
            }
            shaped = net.filters.T.reshape(filters, WIDTH, vector)
            for r, k in enumerate(rows):
                flow = back[r][:, None, None] * shaped
                places = STEP * chosen[r][:, None] + np.arange(WIDTH)
                inside = places < len(data[k])
                flow, places = flow[inside], places[inside]
                np.add.at(grad["bytes_"], data[k][places], flow)
                grad["echo"] += echo[k][places] @ flow
            step += 1
            pace = rate * 0.5 ** (epoch // 4)
            for name in names:
                g = np.asarray(grad[name], np.float32)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, (getattr(net, name) - pace * move).astype(np.float32))
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    net.offset = float(net.offset) + float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(
    docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 20_000, label_col: str = "quality"
) -> Network:
    """Fits on at most ``per_class`` labelled rows of each label and none that is held out.

    The rows are the first by a hash of the id among texts of at most ``longest`` characters; so the
    sample is bounded in bytes. Rows whose id or label is null teach nothing.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .filter("doc_id is not null and label in (0, 1)")
        .filter(~held_out(F.col("doc_id")))
    )
    counts = dict(usable.groupBy("label").count().collect())
    if len(counts) < 2:
        return constant(1.0 if counts.get(1) else 0.0 if counts else 0.5)
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(
        F.length("text") <= longest
    )
    known = usable.join(short.select("doc_id"), "doc_id", "left_semi")
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    chosen = {}
    for row in short.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).collect():
        chosen[row.doc_id] = (row.text, row.label)
    rows = [chosen[k] for k in sorted(chosen)]
    prior = counts[1] / (counts[0] + counts[1])
    return fit([t for t, _ in rows], [n for _, n in rows], prior)


def score(text: Column, net: Network) -> Column:
    """The probability of label 1 for a column of texts; a null text counts as empty."""

    @pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([net.score(x) for x in part], dtype="float64")

    return scores(F.coalesce(text, F.lit("")))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; only the text makes the score.

    A null text is scored as an empty one. Repeated rows and repeated ids are scored each; a null id
    is held out in no fold and gives held_out null. Without labels of both classes the score is the
    share of label 1, or a half without any. A table without rows gives no rows; columns other than
    doc_id and text are not read.
    """
    net = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), net).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
