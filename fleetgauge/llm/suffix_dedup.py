"""Removal of repeated byte strings by suffix arrays that the difference-cover algorithm builds.

A string of ``length`` bytes is known by its anchor, the smallest hash among its 64-byte pieces, so
equal strings have equal anchors at equal places. Suffixes are dealt by the anchor of their first
``length`` bytes; what lies about an anchor in one document, some hundred bytes, travels as one block.
Anchors met once drop out, and blocks met twice as a whole are repeats throughout. The rest goes to
suffix arrays, one for the blocks of some thousand anchors: sampled triples are sorted and named, the
array of names is sorted in the same way, the remaining suffixes are merged in, and neighbours of the
order are compared over ``length`` bytes. So texts never have to be one array, and no row per byte
is shuffled, but the order within a task is that of a suffix array.

Anchors about which very many different blocks stand are dealt further, by the string itself.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import KeyFilter, given_columns, id_and_text, keyed_rows, stored

PIECE = 64
#: Window starts that are looked at together; positions inside take 20 bits.
STRETCH = 1 << 19
#: An anchor with more different blocks than this is dealt by string.
CROWD = 2000
#: Bytes of blocks that one suffix array takes.
ARRAY_BYTES = 1_000_000
#: So many blocks a task remembers, in order not to send them twice.
REMEMBERED = 200_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the PIECE bytes from each position on."""
    with np.errstate(over="ignore"):
        found, width, factor = data.astype(np.uint64) + np.uint64(1), 1, _FACTOR
        while width < PIECE:
            found = found[:-width] * factor + found[width:]
            factor, width = factor * factor, 2 * width
        found ^= found >> np.uint64(31)
        found *= np.uint64(0xD6E8FEB86659FD93)
        return found ^ (found >> np.uint64(29))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row, from running minima of blocks of that width."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def blocks_of(raw: bytes, length: int) -> np.ndarray:
    """Columns anchor hash, first start, last start, place of the anchor, for runs of strings of one anchor."""
    data = np.frombuffer(raw, np.uint8)
    low = np.uint64((1 << 20) - 1)
    found = [np.zeros((4, 0), np.int64)]
    for base in range(0, len(data) - length + 1, STRETCH):
        part = data[base : base + STRETCH + length - 1]
        hashes = piece_hashes(part)
        keyed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        anchors = (sliding_minimum(keyed, length - PIECE + 1) & low).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
        stops = np.r_[starts[1:], len(anchors)] - 1
        at = anchors[starts]
        found.append(np.stack([hashes[at].view(np.int64), starts + base, stops + base, at + base]))
    return np.concatenate(found, axis=1)


def suffix_order(text: np.ndarray, reach: int) -> np.ndarray:
    """Positions of a text of positive numbers in the order of the suffixes' first ``reach`` symbols at
    least, by the difference cover modulo 3.

    Suffixes whose first ``reach`` symbols are equal may stand in any order, next to each other.
    """
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: tuple(text[i:])), np.int64)
    padded = np.r_[text, 0, 0, 0].astype(np.int64)
    positions = np.arange(n + (n % 3 == 1))  # so that the first kind ends with an empty triple
    sample = np.r_[positions[positions % 3 == 1], positions[positions % 3 == 2]]
    size = int(padded.max()) + 1
    if size < 1 << 21:
        triples = (padded[sample] * size + padded[sample + 1]) * size + padded[sample + 2]
    else:
        _, pairs = np.unique(padded[sample] * size + padded[sample + 1], return_inverse=True)
        triples = pairs.astype(np.int64) * size + padded[sample + 2]
    distinct, names = np.unique(triples, return_inverse=True)
    if len(distinct) == len(sample) or reach <= 3:
        order = np.argsort(names, kind="stable")
    else:
        order = suffix_order(names + 1, -(-reach // 3) + 1)
    rank = np.zeros(n + 5, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    rest = positions[(positions % 3 == 0) & (positions < n)]
    wide = np.int64(len(sample) + 2)
    rest_key = padded[rest] * wide + rank[rest + 1]
    rest_order = np.argsort(rest_key, kind="stable")
    rest, rest_key = rest[rest_order], rest_key[rest_order]
    sorted_ = sample[order]
    sorted_ = sorted_[sorted_ < n]
    ones, twos = sorted_[sorted_ % 3 == 1], sorted_[sorted_ % 3 == 2]
    before_ones = np.searchsorted(padded[ones] * wide + rank[ones + 1], rest_key)
    two_pair, rest_pair = padded[twos] * size + padded[twos + 1], padded[rest] * size + padded[rest + 1]
    if size * size >= (1 << 62) // int(wide):
        _, both = np.unique(np.r_[two_pair, rest_pair], return_inverse=True)
        two_pair, rest_pair = both[: len(twos)], both[len(twos) :]
    before_twos = np.searchsorted(two_pair * wide + rank[twos + 2], rest_pair * wide + rank[rest + 2])
    place = np.arange(len(rest)) + before_ones + before_twos
    whole = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place] = False
    whole[place] = rest
    whole[free] = sorted_
    return whole


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text a flag per start of ``length`` bytes: whether they also start elsewhere in these texts."""
    joined = np.frombuffer(b"\0".join(texts) + b"\0" * (length + 8), np.uint8)
    symbols = np.frombuffer(b"\0".join(texts), np.uint8).astype(np.int64) + 2
    ends = np.cumsum([len(x) + 1 for x in texts]) - 1
    begins = np.r_[0, ends[:-1] + 1]
    symbols[ends[:-1]] = 1
    whole = np.zeros(len(symbols), bool)
    for a, b in zip(begins.tolist(), ends.tolist()):
        whole[a : max(a, b - length + 1)] = True
    order = suffix_order(symbols, length)
    order = order[whole[order]]
    left, right = order[:-1], order[1:]
    for at in range(0, length, 8):  # neighbours are compared eight bytes at a time; few go on
        at = min(at, length - 8)
        words = np.lib.stride_tricks.as_strided(joined[at:], (len(symbols), 8), (1, 1))
        same = (words[left] == words[right]).all(axis=1)
        left, right = left[same], right[same]
    found = np.zeros(len(symbols), bool)
    found[left] = True
    found[right] = True
    return [found[a : max(a, b - length + 1)] for a, b in zip(begins.tolist(), ends.tolist())]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of true flags."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


def _arrow(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v, t) for k, (v, t) in columns.items()})


def _row_key(doc_id, raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw, seed=hash(doc_id) & 0xFFFFFFFF if doc_id is not None else 1 << 40) - (1 << 63)


def _content(raw: bytes, first: int, last: int, at: int, length: int) -> int:
    return xxhash.xxh3_64_intdigest(raw[first : last + length], seed=at - first) - (1 << 63)


def _texts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            yield [(d, x.encode()) for d, x in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist())]


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """key, spans: for each document (by a digest of id and text) the bytes to remove, as begin and end.

    ``rows``: doc_id, text. Documents without any have no row.
    """

    def anchor_rows(batches):
        for part in _texts(batches):
            found = np.concatenate([blocks_of(raw, length)[0] for _, raw in part])
            yield _arrow(anchor=(found, pa.int64()))

    anchors = rows.mapInArrow(anchor_rows, "anchor long").groupBy("anchor").count().filter("count > 1")
    repeated = KeyFilter.of(stored(anchors.select("anchor"), "anchors"))

    def met_again(raw: bytes):
        """Blocks of anchors that are met twice, as ``blocks_of``, with the digests of their contents."""
        found = blocks_of(raw, length)
        found = found[:, repeated.may_hold(found[0].view(np.uint64))]
        digests = [_content(raw, first, last, at, length) for first, last, at in found[1:].T.tolist()]
        return found, np.array(digests, np.int64)

    def block_rows(batches):
        for part in _texts(batches):
            each = [met_again(raw) for _, raw in part]
            keys = np.array([_row_key(doc, raw) for doc, raw in part], np.int64)
            found = np.concatenate([x for x, _ in each], axis=1)
            yield _arrow(
                anchor=(found[0], pa.int64()),
                content=(np.concatenate([x for _, x in each]), pa.int64()),
                key=(np.repeat(keys, [len(x) for _, x in each]), pa.int64()),
                first=(found[1], pa.int64()),
                last=(found[2], pa.int64()),
            )

    schema = "anchor long, content long, key long, first long, last long"
    blocks = stored(rows.mapInArrow(block_rows, schema), "blocks")
    contents = stored(
        blocks.groupBy("anchor", "content").agg(
            F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.min("first").alias("first"), F.min("last").alias("last")
        ),
        "block-contents",
    )
    by_anchor = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("different")).filter("different > 1")
    unclear = stored(
        contents.join(by_anchor, "anchor").select("anchor", "content", "n", "key", "first", "different"), "unclear"
    )
    twice = contents.filter("n > 1").select("content")
    wanted = KeyFilter.of(unclear.select("content"))

    def text_rows(batches):
        """The blocks that suffix arrays need; a task sends those met twice once, or a few times at most."""
        seen: set[int] = set()
        for part in _texts(batches):
            out = []
            for doc, raw in part:
                found, contents = met_again(raw)
                asked = wanted.may_hold(contents.view(np.uint64))
                key = _row_key(doc, raw) if asked.any() else 0
                for (anchor, first, last, _), content in zip(found[:, asked].T.tolist(), contents[asked].tolist()):
                    if content not in seen:
                        seen.add(content)
                        out.append((anchor, content, key, first, raw[first : last + length]))
            if len(seen) > REMEMBERED:
                seen = set()
            names = ["anchor", "content", "key", "first"]
            columns = list(zip(*out)) if out else [[]] * 5
            yield _arrow(
                **{k: (list(c), pa.int64()) for k, c in zip(names, columns)}, block=(list(columns[4]), pa.binary())
            )

    texts = rows.mapInArrow(text_rows, "anchor long, content long, key long, first long, block binary")
    joined = stored(texts.join(unclear.select("anchor", "content", "n", "different"), ["anchor", "content"]), "unclear-texts")
    repeated.free()
    wanted.free()
    few = joined.filter(F.col("different") <= CROWD).select("anchor", "content", "n", "key", "first", "block")

    def compare(batches):
        """Suffix arrays over the blocks of whole anchors, some megabytes at a time."""
        held, size, last, last_content = [], 0, None, None

        def results():
            out = []
            if held:
                flags = repeated_starts([x[3] for x in held], length)
                # Blocks of different anchors hold no equal strings at their anchors, so that every hit counts.
                for (n, key, first, _), found in zip(held, flags):
                    if n == 1:
                        out += [(key, first + a, first + b - 1 + length) for a, b in runs(found)]
            columns = list(zip(*out)) if out else [[]] * 3
            return _arrow(**{k: (list(c), pa.int64()) for k, c in zip(("key", "begin", "end"), columns)})

        for batch in batches:
            for anchor, content, n, key, first, block in zip(*(c.to_pylist() for c in batch.columns)):
                if content == last_content and anchor == last:
                    continue  # the same content from another task
                if anchor != last and size > ARRAY_BYTES:
                    yield results()
                    held, size = [], 0
                held.append((n, key, first, block))
                size += len(block)
                last, last_content = anchor, content
        yield results()

    spans_schema = "key long, begin long, end long"
    dealt = few.repartition("anchor").sortWithinPartitions("anchor", "content")
    some = dealt.mapInArrow(compare, spans_schema)

    def strings(batches):
        for batch in batches:
            out = []
            for anchor, content, n, key, first, block in zip(*(c.to_pylist() for c in batch.columns)):
                for k in range(len(block) - length + 1):
                    out.append((xxhash.xxh3_64_intdigest(block[k : k + length]) - (1 << 63), key, first + k, content))
            columns = list(zip(*out)) if out else [[]] * 4
            yield _arrow(
                **{k: (list(c), pa.int64()) for k, c in zip(("string", "key", "begin", "content"), columns)}
            )

    # Equal strings of one content are one string here, whichever task sent it.
    crowd = joined.filter(F.col("different") > CROWD).select("anchor", "content", "n", "key", "first", "block")
    crowd = stored(crowd.mapInArrow(strings, "string long, key long, begin long, content long"), "strings")
    again = (
        crowd.groupBy("string")
        .agg(F.min("content").alias("low"), F.max("content").alias("high"))
        .filter("low <> high")
        .select("string")
    )
    salt = F.pmod(F.xxhash64("key", "begin"), F.lit(16))
    copies = again.withColumn("_salt", F.explode(F.expr("sequence(0L, 15L)")))
    many = crowd.withColumn("_salt", salt).join(copies, ["string", "_salt"], "left_semi")
    many = many.select("key", "begin", (F.col("begin") + length).alias("end"))
    sure = blocks.withColumn("_salt", F.pmod(F.xxhash64("key", "first"), F.lit(16))).join(
        twice.withColumn("_salt", F.explode(F.expr("sequence(0L, 15L)"))),
        ["content", "_salt"],
        "left_semi",
    )
    sure = sure.select("key", F.col("first").alias("begin"), (F.col("last") + length).alias("end"))
    spans = sure.unionByName(some).unionByName(many)
    return stored(
        spans.groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "repeated-spans"
    )


_DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def _cut(moved: DataFrame, spans: DataFrame, make, schema: str) -> DataFrame:
    """``make(ids, texts, spans)`` over documents (key, doc_id, raw) that may have something to remove."""

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, raws, spans = (c.to_pylist() for c in batch.slice(at, 256).columns)
                found = [merged([(x["begin"], x["end"]) for x in s or []]) for s in spans]
                yield make(ids, raws, found)

    return moved.join(spans, "key", "left").select("doc_id", "raw", "spans").mapInArrow(cut, schema)


def _split(part, has_some: KeyFilter):
    """The documents without anything to remove, and a batch (key, doc_id, raw) of those that may have."""
    keys = np.array([_row_key(d, raw) for d, raw in part], np.int64)
    moves = has_some.may_hold(keys.view(np.uint64))
    chosen = [x for x, m in zip(part, moves) if m]
    moved = {
        "key": (keys[moves], pa.int64()),
        "doc_id": ([d for d, _ in chosen], pa.int64()),
        "raw": ([raw for _, raw in chosen], pa.binary()),
    }
    return [x for x, m in zip(part, moves) if not m], moved


def suffix_array_dedup(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, and the SHA-256 of what is kept.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same
    document or another; all are judged on the input. A null text counts as empty; rows that repeat a
    row are documents of their own and so repeat each other; a null id is an id like others. A table
    without rows gives no rows; columns other than the two named are not read. Blocks and rows are known
    by 64-bit digests.
    """
    rows = id_and_text(docs, id_col, text_col)

    def digests(ids, raws, spans):
        return _arrow(
            doc_id=(ids, pa.int64()),
            n_bytes=([len(x) for x in raws], pa.int64()),
            n_removed=([sum(b - a for a, b in s) for s in spans], pa.int64()),
            n_spans=([len(s) for s in spans], pa.int64()),
            kept_sha256=([hashlib.sha256(_kept(x, s)).hexdigest() for x, s in zip(raws, spans)], pa.string()),
        )

    spans = repeated_spans(rows, length)
    has_some = KeyFilter.of(spans.select("key"))

    def judged(batches):
        """One pass over the texts: finished rows, and the texts of the others."""
        for part in _texts(batches):
            whole, moved = _split(part, has_some)
            done = digests([d for d, _ in whole], [raw for _, raw in whole], [[] for _ in whole])
            rest = _arrow(**moved)
            both = pa.concat_tables([pa.Table.from_batches([x]) for x in (done, rest)], promote_options="default")
            moves = pa.array([False] * done.num_rows + [True] * rest.num_rows)
            yield from both.append_column("moves", moves).combine_chunks().to_batches()

    every = stored(rows.mapInArrow(judged, _DIGESTS + ", key long, raw binary, moves boolean"), "judged-texts")
    has_some.free()
    done = every.filter("not moves").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    moved = every.filter("moves").select("key", "doc_id", "raw")
    return done.unionByName(_cut(moved, spans, digests, _DIGESTS))


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """The documents with the repeated strings cut out of ``text``; other columns as they were.

    Characters that a cut halves go whole. Rows stay, also where nothing is left of their text.
    """
    keyed = keyed_rows(docs)
    rows = id_and_text(keyed, "_key", "_text")

    def texts(ids, raws, spans):
        kept = [_kept(x, s).decode("utf-8", "ignore") for x, s in zip(raws, spans)]
        return _arrow(_key=(ids, pa.int64()), _kept=(kept, pa.string()))

    spans = repeated_spans(rows, length)
    has_some = KeyFilter.of(spans.select("key"))

    def moved(batches):
        for part in _texts(batches):
            yield _arrow(**_split(part, has_some)[1])

    some = rows.mapInArrow(moved, "key long, doc_id long, raw binary")
    kept = _cut(some, spans, texts, "_key long, _kept string").dropDuplicates(["_key"])
    text = F.coalesce("_kept", "_text", F.lit(""))
    return keyed.join(kept, "_key", "left").select(given_columns(docs, text))
