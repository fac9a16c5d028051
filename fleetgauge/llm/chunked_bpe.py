"""Byte-level BPE of a corpus with content-defined chunk reuse.

A rolling hash over 32 bytes cuts texts where it says so, wherever the passage stands, so documents
that share a passage share its chunks. Chunks met more than once are encoded once for the whole
corpus. Where chunks meet, tokens may reach over the cut: the join is re-encoded from the last
place in the left chunk where its tokens cannot change to the first such place in the right one,
and over further chunks where one has no such place, so the ids agree exactly with those of the
whole text. Chunks met once are encoded where their document lies, and only documents that hold a
shared chunk are moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import id_and_text, member_filter, stored
from fleetgauge.llm.subwords import Subwords, first_cut, last_cut, subwords

WINDOW = 32
_GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 32, 256, np.uint32)
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def cut_points(data: np.ndarray, bits: int) -> np.ndarray:
    """Ends of chunks, inside the text, at starts of characters; one in 2**bits bytes on average."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    rolling = _GEAR[data]
    width = 1
    while width < WINDOW:
        longer = rolling.copy()
        longer[width:] += rolling[:-width] << np.uint32(width)
        rolling, width = longer, 2 * width
    at = np.flatnonzero(rolling[WINDOW - 1 : -1] >> np.uint32(32 - bits) == 0) + WINDOW
    for _ in range(3):
        at = at + ((at < len(data)) & (data[np.minimum(at, len(data) - 1)] & 0xC0 == 0x80))
    return np.unique(at[at < len(data)])


def chunks(text: str, bits: int) -> list[bytes]:
    raw = text.encode()
    ends = [0, *cut_points(np.frombuffer(raw, np.uint8), bits).tolist(), len(raw)]
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def _number(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def stored_as(encoder: Subwords) -> str:
    return "<u2" if len(encoder.table) <= 1 << 16 else "<u4"


class Core:
    """A chunk between its first and last safe places: what stands before, its ids, what stands after."""

    __slots__ = ("before", "ids", "after")

    def __init__(self, before: str | None, ids: np.ndarray | None, after: str):
        self.before, self.ids, self.after = before, ids, after


def cores(encoder: Subwords, texts: list[str]) -> list[Core]:
    spans = [(first_cut(x), last_cut(x)) for x in texts]
    inner = [x[a:b] if a is not None else "" for x, (a, b) in zip(texts, spans)]
    coded = encoder.encode_column(pa.array(inner, pa.string()))
    return [
        Core(None, None, x) if a is None else Core(x[:a], ids, x[b:])
        for x, (a, b), ids in zip(texts, spans, coded)
    ]


def join_cores(encoder: Subwords, documents: list[list[Core]]) -> list[np.ndarray]:
    """The ids of documents from their chunks in order; every join is encoded anew."""
    joins: list[str] = []
    plans = []
    for parts in documents:
        plan, pending = [], ""
        for core in parts:
            if core.ids is None:
                pending += core.after
                continue
            plan += [len(joins), core.ids]
            joins.append(pending + core.before)
            pending = core.after
        plan.append(len(joins))
        joins.append(pending)
        plans.append(plan)
    coded = encoder.encode_column(pa.array(joins, pa.string()))
    return [np.concatenate([coded[x] if isinstance(x, int) else x for x in plan]) for plan in plans]


class Summary:
    """The digests a document's ids give."""

    def __init__(self, encoder: Subwords):
        self._bytes = encoder.table
        self._digits = [str(k).encode() for k in range(len(encoder.table))]

    def __call__(self, ids: np.ndarray) -> tuple[int, str, str]:
        numbers = ids.tolist()
        decoded = b"".join(map(self._bytes.__getitem__, numbers)).decode("utf-8", "replace")
        listed = b",".join(map(self._digits.__getitem__, numbers))
        return len(numbers), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _texts(batches: Iterable[pa.RecordBatch], at_once: int = 512) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, at_once):
            part = batch.slice(k, at_once)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v, kind) for k, (v, kind) in columns.items()})


def chunk_reuse_encoding(
    docs: DataFrame, tokenizer: str, bits: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the text decoded from them.

    A null text counts as empty and has no ids. Each row is a document, also where it repeats another
    row or has a null id; equal texts give equal results. A table without rows gives no rows. Columns
    other than the two named are not read. Texts may have any length: a text without a safe place is
    encoded as one join.
    """
    rows = id_and_text(docs, id_col, text_col)

    def digest_rows(batches):
        for _, texts in _texts(batches):
            found = [xxhash.xxh3_128_digest(c) for x in texts for c in chunks(x, bits)]
            yield _batch({"digest": (found, pa.binary())})

    def numbers(batches):
        for batch in batches:
            yield _batch({"number": ([_number(x) for x in batch.column(0).to_pylist()], pa.int64())})

    repeated = rows.mapInArrow(digest_rows, "digest binary").groupBy("digest").count().filter("count > 1")
    may_hold = member_filter(repeated.select("digest").mapInArrow(numbers, "number long"))

    def may_be_shared(digest: bytes) -> bool:
        return may_hold(_number(digest))

    def digested(text: str) -> tuple[list[bytes], list[bytes], list[bool]]:
        parts = chunks(text, bits)
        digests = [xxhash.xxh3_128_digest(c) for c in parts]
        return parts, digests, [may_be_shared(d) for d in digests]

    def pool_texts(batches):
        seen: set[bytes] = set()
        for batch in batches:
            found = {}
            for text in batch.column(0).to_pylist():
                for part, digest, hit in zip(*digested(text)):
                    if hit and digest not in seen:
                        seen.add(digest)
                        found[digest] = part
            if len(seen) > 500_000:
                seen = set()
            yield _batch({"digest": (list(found), pa.binary()), "chunk": (list(found.values()), pa.binary())})

    def encode_pool(batches):
        encoder, last = subwords(tokenizer), b""
        for batch in batches:
            fresh: dict[bytes, str] = {}
            for digest, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest != last:
                    fresh[digest] = part.decode()
                last = digest
            coded = cores(encoder, list(fresh.values()))
            yield _batch(
                {
                    "digest": (list(fresh), pa.binary()),
                    "before": ([c.before for c in coded], pa.string()),
                    "ids": ([None if c.ids is None else c.ids.astype(stored_as(encoder)).tobytes() for c in coded], pa.binary()),
                    "after": ([c.after for c in coded], pa.string()),
                }
            )

    def key_of(text: str) -> bytes:
        return xxhash.xxh3_128_digest(text.encode())

    def moved_texts(batches):
        """Each text with shared chunks once for all rows of some megabytes that have it, with their ids."""
        found: dict[bytes, tuple[str, list, set]] = {}
        size = 0

        def flush():
            return _batch(
                {
                    "key": (list(found), pa.binary()),
                    "text": ([text for text, _, _ in found.values()], pa.string()),
                    "doc_ids": ([ids for _, ids, _ in found.values()], pa.list_(pa.int64())),
                    "shared": ([list(shared) for _, _, shared in found.values()], pa.list_(pa.binary())),
                }
            )

        for ids, texts in _texts(batches):
            for doc, text in zip(ids, texts):
                if (key := key_of(text)) not in found:
                    _, digests, hits = digested(text)
                    shared = {d for d, hit in zip(digests, hits) if hit}
                    if not shared:
                        continue
                    found[key] = (text, [], shared)
                    size += len(text) + 16 * len(shared)
                found[key][1].append(doc)
                size += 8
            if size > 16_000_000:
                yield flush()
                found, size = {}, 0
        yield flush()

    moved = stored(
        rows.mapInArrow(moved_texts, "key binary, text string, doc_ids array<long>, shared array<binary>"),
        "texts-with-shared-chunks",
    )

    pool = stored(
        moved.select("text").mapInArrow(pool_texts, "digest binary, chunk binary")
        .repartition("digest")
        .sortWithinPartitions("digest")
        .mapInArrow(encode_pool, "digest binary, before string, ids binary, after string"),
        "encoded-chunks",
    )

    def assemble(batches):
        encoder = subwords(tokenizer)
        summary = Summary(encoder)
        last, result = None, None  # rows of one text follow one another
        for batch in batches:
            ids, results = [], []
            for k in range(batch.num_rows):
                documents = batch.column(3)[k].as_py()
                ids += documents
                if (key := batch.column(0)[k].as_py()) == last:
                    results += [result] * len(documents)
                    continue
                known = {
                    x["digest"]: Core(x["before"], np.frombuffer(x["ids"], stored_as(encoder)).astype(np.uint32), x["after"])
                    if x["ids"] is not None
                    else Core(None, None, x["after"])
                    for x in batch.column(2)[k].as_py()
                }
                parts, digests, _ = digested(batch.column(1)[k].as_py())
                own = [(i, d) for i, d in enumerate(digests) if d not in known]
                for (_, digest), core in zip(own, cores(encoder, [parts[i].decode() for i, _ in own])):
                    known[digest] = core
                (coded,) = join_cores(encoder, [[known[d] for d in digests]])
                last, result = key, summary(coded)
                results += [result] * len(documents)
            yield _results(ids, results)

    def _results(ids, results):
        n, listed, decoded = zip(*results) if results else ((), (), ())
        return _batch(
            {
                "doc_id": (ids, pa.int64()),
                "n_tokens": (list(n), pa.int64()),
                "ids_sha256": (list(listed), pa.string()),
                "decoded_sha256": (list(decoded), pa.string()),
            }
        )

    def in_place(batches):
        encoder = subwords(tokenizer)
        summary = Summary(encoder)
        for ids, texts in _texts(batches):
            alone = [(doc, parts) for doc, x in zip(ids, texts) for parts, _, hits in [digested(x)] if not any(hits)]
            coded = cores(encoder, [c.decode() for _, parts in alone for c in parts])
            split, at = [], 0
            for _, parts in alone:
                split.append(coded[at : at + len(parts)])
                at += len(parts)
            results = [summary(x) for x in join_cores(encoder, split)]
            yield _results([doc for doc, _ in alone], results)

    references = moved.select("key", F.explode("shared").alias("digest")).distinct()
    per_text = (
        references.join(pool, "digest")
        .groupBy("key")
        .agg(F.collect_list(F.struct("digest", "before", "ids", "after")).alias("cores"))
    )
    assembled = (
        moved.join(per_text, "key")
        .select("key", "text", "cores", "doc_ids")
        .mapInArrow(assemble, f"doc_id long, {RESULT}")
    )
    return rows.mapInArrow(in_place, f"doc_id long, {RESULT}").unionByName(assembled)
