"""Chunk-reuse encoding and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fleetgauge.llm.chunked_bpe import chunk_reuse_encoding, cut_points
from fleetgauge.llm.packing import harmonic_packing, piece_lengths
from fleetgauge.llm.subwords import Subwords

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_columns_encode_as_whole_texts(library):
    rng = random.Random(1)
    parts = [*"ab'sé  \n\t᠎\x1c\x85 .,1漢", "<|endoftext|>", "'ll", "     ", "hello world"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    encoder = Subwords(PATH, keep=50)
    for text, ids in zip(texts, encoder.encode_column(pa.array(texts))):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_cuts_depend_on_content_only():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 20_000, np.uint8)
    before = np.concatenate([rng.integers(97, 123, 777, np.uint8), shared])
    one, two = set(cut_points(shared, 8).tolist()), {x - 777 for x in cut_points(before, 8).tolist()}
    assert {x for x in one if x > 32} == {x for x in two if x > 32}


def test_encoding_round_trip(spark, docs, rows, library, none):
    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        listed = ",".join(map(str, ids)).encode()
        want.append((doc, len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = [tuple(r) for r in chunk_reuse_encoding(docs, PATH, bits=6).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert chunk_reuse_encoding(none, PATH).count() == 0


def test_packing_covers_each_id_once(spark, docs, rows, library, none):
    got = harmonic_packing(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), PATH).collect()
    texts = {doc: text or "" for doc, text in rows}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {doc for doc, _ in rows if doc is not None}
    for doc, pieces in by_doc.items():
        ids = np.array([*library.encode(texts[doc], add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    held = padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and r.sequence_length == (at if at & (at - 1) == 0 else 1024)
        held, padded = held + at, padded + r.sequence_length
    assert padded < 1.05 * held
    assert harmonic_packing(none, PATH).count() == 0


def test_repeated_rows_are_packed_each(spark, docs):
    rows = docs.filter("doc_id = 900004")
    assert harmonic_packing(rows, PATH).count() == 2 * harmonic_packing(rows.limit(1), PATH).count()


@pytest.mark.parametrize("tokens", [1, 15, 16, 17, 1023, 1024, 1025, 5000])
def test_pieces_fill_their_class(tokens):
    lengths = piece_lengths(tokens, 1024, 16)
    assert sum(lengths) == tokens
    assert all(x < 16 or x & (x - 1) == 0 for x in lengths)
