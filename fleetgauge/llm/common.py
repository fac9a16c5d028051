"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.sources.scratch import fresh_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns operators read, so that no further column can clash with theirs."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``_key`` (a digest of id and text), ``_text``, and ``_row`` with the other columns, whatever their names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.xxhash64("doc_id", "text").alias("_key"), F.col("text").alias("_text"), F.struct(*others).alias("_row"))


def given_columns(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of ``docs`` again from ``keyed_rows``, with another text."""
    return [text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns]


def stored(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """The rows of a frame, written to the cluster's shared folder and read back.

    This cuts the lineage: a lost executor costs the reading of some files, not the work above.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, facts: DataFrame, key: str, spread_by: str, salts: int = 32) -> DataFrame:
    """Left join of ``facts`` (one row per key, few columns) to rows of which one key may hold most.

    Rows are dealt by (key, salt), the salt from the column ``spread_by``, and each fact is repeated
    once per salt, so a hot key is spread over ``salts`` tasks before adaptive splitting, and a group
    never meets in one.
    """
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [key, "_salt"], "left").drop("_salt")


#: A filter of keys has this many words of 64 bits, whatever the number of keys. A full filter lets
#: keys through that aren't members and never stops one that is.
FILTER_WORDS, PAGE = 1 << 20, 1 << 12


def member_filter(keys: DataFrame) -> Callable[[int], bool]:
    """A test whether a 64-bit key may be in the only column of ``keys``, for use inside tasks.

    The table comes to the driver in at most FILTER_WORDS / PAGE pages, 8 MB together, is folded until
    one bit in 128 or more is set, and goes out.
    """
    name = keys.columns[0]
    place = F.pmod(F.col(name), F.lit(FILTER_WORDS * 64))
    words = (
        keys.select((place / 64).cast("long").alias("word"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    )

    def paged(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            word, bits = (c.to_numpy() for c in batch.columns)
            for page in np.unique(word // PAGE).tolist():
                own = word // PAGE == page
                table = held.setdefault(page, np.zeros(PAGE, np.int64))
                table[word[own] % PAGE] |= bits[own]
        yield pa.RecordBatch.from_pydict(
            {
                "page": pa.array(list(held), pa.int64()),
                "bits": pa.array([x.tobytes() for x in held.values()], pa.binary()),
            }
        )

    tasks = 16
    dealt = words.repartition(tasks, (F.col("word") / PAGE).cast("long"))
    table = np.zeros(FILTER_WORDS, np.int64)
    for page, bits in dealt.mapInArrow(paged, "page long, bits binary").collect():
        table[page * PAGE : (page + 1) * PAGE] = np.frombuffer(bits, np.int64)
    # A key's place is a remainder, so halves of a sparse table can lie upon each other.
    set_ = int(np.bitwise_count(table).sum())
    while len(table) > 64 and set_ * 128 <= len(table) * 64:
        table = table[: len(table) // 2] | table[len(table) // 2 :]
    bits, table = len(table) * 64, table.view(np.uint64)
    shared = keys.sparkSession.sparkContext.broadcast(table)

    def may_hold(key: int) -> bool:
        word, bit = divmod(key % bits, 64)
        return bool((int(shared.value[word]) >> bit) & 1)

    return may_hold


class KeyFilter:
    """Whether a 64-bit hash may be among given ones, for whole arrays inside tasks.

    The table has 16 bits a key, sized by a count, and at most ``MOST_BITS`` (64 MB): beyond that it lets
    more keys through that aren't members, and never stops one that is.
    """

    MOST_BITS, PROBES = 1 << 29, 4

    def __init__(self, keys: int, bits: int, shared):
        self.keys, self.bits, self.shared = keys, bits, shared

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        low, step = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        for probe in range(KeyFilter.PROBES):
            yield ((low + np.uint64(probe) * step) & np.uint64(bits - 1)).astype(np.int64)

    @classmethod
    def of(cls, hashes: DataFrame) -> KeyFilter:
        """From the only column of ``hashes``, of longs that are well mixed already."""
        keys = hashes.count()
        bits = 1 << 16
        while bits < min(16 * keys, cls.MOST_BITS):
            bits *= 2

        def marked(batches):
            for batch in batches:
                for at in cls.places(batch.column(0).to_numpy().view(np.uint64), bits):
                    yield pa.record_batch([pa.array(at >> 6), pa.array(at & 63)], names=["word", "bit"])

        def paged(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                word, found = (c.to_numpy() for c in batch.columns)
                for page in np.unique(word // PAGE).tolist():
                    own = word // PAGE == page
                    held.setdefault(page, np.zeros(PAGE, np.int64))[word[own] % PAGE] |= found[own]
            pages, tables = list(held), [x.tobytes() for x in held.values()]
            yield pa.record_batch([pa.array(pages, pa.int64()), pa.array(tables, pa.binary())], names=["page", "bits"])

        words = hashes.mapInArrow(marked, "word long, bit long").groupBy("word")
        words = words.agg(F.expr("bit_or(shiftleft(1L, cast(bit as int)))").alias("bits"))
        dealt = words.repartition(16, (F.col("word") / PAGE).cast("long"))
        table = np.zeros(max(bits // 64, PAGE), np.int64)
        for page, found in dealt.mapInArrow(paged, "page long, bits binary").collect():
            table[page * PAGE : (page + 1) * PAGE] = np.frombuffer(found, np.int64)
        shared = hashes.sparkSession.sparkContext.broadcast(table.view(np.uint64))
        return cls(keys, bits, shared)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        table, found = self.shared.value, np.ones(len(hashes), bool)
        for at in self.places(hashes, self.bits):
            found &= (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
        return found

    def free(self) -> None:
        self.shared.unpersist()
