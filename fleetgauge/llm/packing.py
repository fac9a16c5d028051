"""Harmonic packing of token ids into sequences of fixed capacity.

A length in (capacity / (k + 1), capacity / k] belongs to class k, and k of that class fill one
bin. As documents may be cut, they are cut at lengths that fill their class exactly: whole
sequences, then one piece per power of two down to ``finest``, then the few ids that are left as
one piece whose length is its class. Each partition fills its own bins, so nothing is shuffled, no
partition waits for another, and at most one bin of each class is open at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fleetgauge.llm.common import id_and_text
from fleetgauge.llm.subwords import subwords

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long,"
    " offset long, sequence_length long"
)
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


def piece_lengths(tokens: int, capacity: int, finest: int) -> list[int]:
    """How a document of so many ids is cut: capacity, then falling powers of two, then the rest."""
    lengths = [capacity] * (tokens // capacity)
    rest, size = tokens % capacity, capacity // 2
    while size >= finest and rest:
        if rest >= size:
            lengths.append(size)
            rest -= size
        size //= 2
    return lengths + [rest] * (rest > 0)


class Bins:
    """The open bins of one worker, a bin per class, and the sequences it has closed."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next_sequence = capacity, first_sequence
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        total, offset = sum(p[2] for p in pieces), 0
        # A sequence whose length is a power of two is used as it is; others are padded.
        length = total if total & (total - 1) == 0 else self.capacity
        for piece in pieces:
            self.rows.append((*piece, self.next_sequence, offset, length))
            offset += piece[2]
        self.next_sequence += 1

    def add(self, piece: tuple) -> None:
        size = piece[2]
        held = self.open.setdefault(size, [])
        held.append(piece)
        if len(held) == self.capacity // size:
            self.close(self.open.pop(size))

    def finish(self) -> None:
        """Bins that stay open: powers of two close in runs that are powers of two themselves; the
        remaining short pieces share bins, longest first."""
        short = []
        for size, held in sorted(self.open.items(), reverse=True):
            if size & (size - 1) or size < 16:
                short += held
                continue
            while held:
                run = 1 << (len(held).bit_length() - 1)
                self.close(held[:run])
                held = held[run:]
        bin_, filled = [], 0
        for piece in short:
            if filled + piece[2] > self.capacity:
                self.close(bin_)
                bin_, filled = [], 0
            bin_.append(piece)
            filled += piece[2]
        if bin_:
            self.close(bin_)
        self.open = {}


def harmonic_packing(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 0,
    finest: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document: where it starts, which sequence holds it and at which offset.

    ``capacity`` and ``finest`` are powers of two. Every document ends with ``end_id``, so a null or
    empty text is one piece of one id. Rows are packed one by one: a repeated row, a repeated
    ``doc_id`` or a null ``doc_id`` is one more document with the id it has. A table without rows
    gives no rows; columns other than the two named are not read. Sequence numbers are unique but not
    consecutive over workers. ``sequence_length`` is what the sequence holds after padding.
    """
    assert capacity & (capacity - 1) == 0 and finest & (finest - 1) == 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = subwords(tokenizer)
        end = end_id.to_bytes(4, "little")
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)

        def flush():
            rows, bins.rows = bins.rows, []
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 8,
                schema=_ARROW,
            )

        for batch in batches:
            docs_here, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(texts), 1024):
                coded_texts = encoder.encode_column(texts.slice(at, 1024))
                for doc, ids in zip(docs_here[at : at + 1024], coded_texts):
                    coded = ids.astype("<u4").tobytes() + end
                    tokens, start = len(coded) // 4, 0
                    for length in piece_lengths(tokens, capacity, finest):
                        crc = zlib.crc32(coded[4 * start : 4 * (start + length)])
                        bins.add((doc, start, length, crc, tokens))
                        start += length
                if len(bins.rows) > 20_000:
                    yield flush()
        bins.finish()
        yield flush()

    return id_and_text(docs, id_col, text_col).mapInArrow(pack, SCHEMA)
