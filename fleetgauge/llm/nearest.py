"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors get one more coordinate that makes all of them equally long, so the largest inner product
is the smallest distance. Each table rounds a few Gaussian projections to a grid. A query visits its
own cell and cells next to it in the order of the estimated chance that a near vector fell there; the
cells of all tables together give its candidates, whose inner products are computed exactly.

Tables are cut into blocks of bounded size, large cells into several, and queries are dealt to the
blocks that hold their cells, so neither a crowded cell nor a table meets in one task.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import stored

_CANDIDATES = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Tables:
    """The hash functions: ``tables`` grids of ``size`` projections each."""

    def __init__(self, dims: int, largest: float, width: float, tables: int = 4, size: int = 8, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.largest, self.width, self.tables = largest, width, tables
        self.lines = rng.normal(size=(tables, dims + 1, size))
        self.shifts = rng.uniform(0, width, (tables, size))
        self.mixers = rng.integers(1, 1 << 62, size, np.int64) | 1
        self.steps = np.array(list(product((-1, 0, 1), repeat=size)), np.int64)

    def _places(self, vectors: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        at = (vectors @ self.lines[table] + self.shifts[table]) / self.width
        cells = np.floor(at)
        return cells.astype(np.int64), at - cells

    def stretched(self, vectors: np.ndarray) -> np.ndarray:
        short = np.maximum(self.largest**2 - (vectors**2).sum(axis=1), 0) ** 0.5
        return np.column_stack([vectors, short])

    def aimed(self, queries: np.ndarray) -> np.ndarray:
        lengths = np.linalg.norm(queries, axis=1, keepdims=True)
        return np.column_stack([queries * (self.largest / lengths), np.zeros(len(queries))])

    def cells(self, stretched: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self._places(stretched, table)[0] * self.mixers).sum(axis=1)

    def probes(self, aimed: np.ndarray, table: int, count: int) -> np.ndarray:
        """Row by row the cells to visit, likeliest first: a step costs the squared way to that side."""
        places, inside = self._places(aimed, table)
        cost = np.stack([inside**2, np.zeros_like(inside), (1 - inside) ** 2])
        found = np.empty((len(aimed), count), np.int64)
        columns = np.arange(places.shape[1])
        for k in range(len(aimed)):
            total = cost[self.steps + 1, k, columns].sum(axis=1)
            order = np.argsort(total, kind="stable")[:count]
            with np.errstate(over="ignore"):
                found[k] = ((places[k] + self.steps[order]) * self.mixers).sum(axis=1)
        return found


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    at = np.arange(len(ids))
    if len(ids) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of rows that take part: not null, not zero, every component a finite number."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vec"))
        .filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
        .filter(F.exists("vec", lambda x: x != 0))
    )


def _exact(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The true neighbours of a bounded set of queries, by one pass over all vectors."""
    dims = queries.shape[1]

    def scan(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            others, matrix = batch.column(0).to_numpy(), _matrix(batch.column(1), dims)
            found = []
            for query, vector in zip(ids, queries):
                scores = (matrix * vector).sum(axis=1)
                scores[others == query] = -np.inf
                top = best(others, scores, k)
                top = top[scores[top] > -np.inf]
                found.append(
                    pa.record_batch(
                        [
                            pa.array(np.full(len(top), query)),
                            pa.array(others[top]),
                            pa.array(scores[top]),
                            pa.array(list(matrix[top]), pa.list_(pa.float64())),
                        ],
                        names=["query_id", "vec_id", "score", "vec"],
                    )
                )
            yield from found

    each = vectors.mapInArrow(scan, "query_id long, vec_id long, score double, vec array<double>")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def _calibrated(tables: Tables, vectors: DataFrame, sample: list, k: int, target: float) -> int:
    """How many cells to visit in each table for the wanted recall on the sampled queries."""
    ids = np.array([r.vec_id for r in sample], np.int64)
    queries = np.array([r.vec for r in sample], np.float64)
    truth = _exact(vectors, ids, queries, k).collect()  # at most k rows a sampled query
    if not truth:
        return 1
    row_of = {q: i for i, q in enumerate(ids)}
    owner = np.array([row_of[r.query_id] for r in truth])
    near = tables.stretched(np.array([r.vec for r in truth], np.float64))
    most = len(tables.steps)
    first = np.full(len(truth), most)
    for table in range(tables.tables):
        visited = tables.probes(tables.aimed(queries), table, most)
        cells = tables.cells(near, table)
        hit = visited[owner] == cells[:, None]
        first = np.minimum(first, np.where(hit.any(axis=1), hit.argmax(axis=1), most))
    return int(min(most, np.quantile(first, target, method="higher") + 1))


def nearest_by_inner_product(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    tables: int = 4,
    recall: float = 0.95,
    sampled: int = 96,
    block: int = 20_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of all rows but itself.

    The number of cells a query visits is the smallest with the wanted recall on ``sampled`` queries,
    whose true neighbours are found by brute force. A query with fewer than k candidates is compared
    with every row, so only a table with too few rows gives shorter lists. Vectors that are null, zero
    or hold a null or non-finite component take no part, nor do vectors whose length differs from
    most; rows with a null id neither. Rows that repeat an id are one vector, of which the first in
    order counts. Ties go to the smaller id; an empty table gives no rows; further columns aren't read.
    """
    spark = rows.sparkSession

    def cleaned(df):
        each = usable_vectors(df, id_col, vector_col)
        return each.groupBy("vec_id").agg(F.min("vec").alias("vec"))

    every = stored(cleaned(rows), "vectors")
    shapes = every.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if shapes is None:
        return empty
    dims = shapes.dims
    every = every.filter(F.size("vec") == dims)
    asked = stored(cleaned(queries).filter(F.size("vec") == dims), "queries")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    largest, total = every.agg(F.max(length), F.count(F.lit(1))).first()
    sample = asked.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(sampled).collect()
    if not sample:
        return empty
    hashing = Tables(dims, largest, width=2.0 * largest, tables=tables)
    count = _calibrated(hashing, every, sample, k, recall)
    parts = -(-total // block)
    query_blocks = -(-asked.count() // block)

    def cell_rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            wide = hashing.stretched(_matrix(batch.column(1), dims))
            for table in range(tables):
                yield pa.record_batch(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(np.full(batch.num_rows, table, np.int32)),
                        pa.array(hashing.cells(wide, table)),
                    ],
                    names=["vec_id", "vec", "table", "cell"],
                )

    def probe_rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                aimed = hashing.aimed(_matrix(piece.column(1), dims))
                for table in range(tables):
                    visited = hashing.probes(aimed, table, count)
                    yield pa.record_batch(
                        [
                            pa.array(np.repeat(piece.column(0).to_numpy(), count)),
                            pa.array(np.full(visited.size, table, np.int32)),
                            pa.array(visited.ravel()),
                        ],
                        names=["query_id", "table", "cell"],
                    )

    placed = stored(every.mapInArrow(cell_rows, "vec_id long, vec array<double>, table int, cell long"), "cells")
    crowd = block // 4
    split = F.ceil(F.col("n") / crowd).cast("int")
    cells = placed.groupBy("table", "cell").agg(F.count(F.lit(1)).alias("n")).select("table", "cell", split.alias("s"))

    def sub_cell(piece):
        return F.xxhash64("table", "cell", piece)

    crowded = cells.filter("s > 1")
    indexed = placed.join(crowded, ["table", "cell"], "left").withColumn(
        "sub", sub_cell(F.pmod(F.xxhash64("vec_id"), F.coalesce("s", F.lit(1))).cast("int"))
    )
    index_rows = indexed.select(
        "table",
        F.pmod("sub", F.lit(parts)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("turn"),
        F.lit(0).alias("kind"),
        "vec_id",
        "vec",
        F.array("sub").alias("subs"),
    )

    def query_rows(wanted: DataFrame, visits: DataFrame) -> DataFrame:
        """``visits``: query_id, table, sub."""
        lists = visits.groupBy("query_id", "table", F.pmod("sub", F.lit(parts)).cast("int").alias("part")).agg(
            F.collect_set("sub").alias("subs")  # at most the cells one query visits
        )
        return lists.join(wanted.withColumnRenamed("vec_id", "query_id"), "query_id").select(
            "table",
            "part",
            F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("turn"),
            F.lit(1).alias("kind"),
            F.col("query_id").alias("vec_id"),
            "vec",
            "subs",
        )

    def search(batches):
        """Streams blocks: first a block's vectors, then its queries."""
        here, held, members, ids, matrix = None, [], {}, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = np.column_stack([batch.column(c).to_numpy() for c in (0, 1, 2, 3)])
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges], [*edges, len(blocks)]):
                key, kind = tuple(blocks[a][:3]), blocks[a][3]
                piece = batch.slice(a, b - a)
                if key != here:
                    here, held, members, ids = key, [], None, None
                if kind == 0:
                    subs = piece.column(6).flatten().to_numpy()
                    held.append((subs, piece.column(4).to_numpy(), _matrix(piece.column(5), dims)))
                    members = None
                    continue
                if not held:
                    continue
                if members is None:
                    subs = np.concatenate([x[0] for x in held])
                    order = np.argsort(subs, kind="stable")
                    subs = subs[order]
                    ids = np.concatenate([x[1] for x in held])[order]
                    matrix = np.concatenate([x[2] for x in held])[order]
                    starts = np.flatnonzero(np.r_[True, subs[1:] != subs[:-1]])
                    stops = np.r_[starts[1:], len(subs)]
                    members = {s: (x, y) for s, x, y in zip(subs[starts].tolist(), starts, stops)}
                asking, vectors = piece.column(4).to_numpy(), _matrix(piece.column(5), dims)
                found = []
                for row, (query, vector) in enumerate(zip(asking.tolist(), vectors)):
                    spans = [members[s] for s in piece.column(6)[row].as_py() if s in members]
                    if not spans:
                        continue
                    at = np.concatenate([np.arange(x, y) for x, y in spans])
                    at = at[ids[at] != query]
                    scores = (matrix[at] * vector).sum(axis=1)
                    top = best(ids[at], scores, k)
                    found.append((np.full(len(top), query), ids[at][top], scores[top]))
                if found:
                    columns = [np.concatenate(c) for c in zip(*found)]
                    yield pa.record_batch([pa.array(c) for c in columns], schema=_CANDIDATES)

    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def answered(wanted: DataFrame, visits: DataFrame) -> DataFrame:
        both = index_rows.unionByName(query_rows(wanted, visits))
        tasks = max(parts * tables * query_blocks, 8)
        dealt = both.repartition(tasks, "table", "part", "turn").sortWithinPartitions("table", "part", "turn", "kind")
        found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
        merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        ranked = merged.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
        return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    pieces = cells.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).select(
        "table", "cell", sub_cell(F.col("piece")).alias("sub")
    )
    visits = asked.mapInArrow(probe_rows, "query_id long, table int, cell long").join(pieces, ["table", "cell"])
    results = stored(answered(asked, visits.select("query_id", "table", "sub")), "neighbours")
    enough = min(k, total - 1)
    full = results.groupBy("query_id").count().filter(F.col("count") >= enough)
    short = stored(asked.join(full, asked.vec_id == full.query_id, "left_anti"), "short-queries")
    if enough < 1 or short.isEmpty():
        return results
    # These visit every cell of the first table, block by block.
    whole = pieces.filter("table = 0").select("table", "sub", F.pmod("sub", F.lit(64)).alias("_deal"))
    spread = short.select(
        F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(63))).cast("long").alias("_deal")
    )
    rest = answered(short, spread.join(whole, "_deal").select("query_id", "table", "sub"))
    kept = results.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return kept.unionByName(rest)
