"""Collocations against counting every phrase."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import phrase_mining
from fleetgauge.llm.common import KeyFilter
from fleetgauge.llm.phrase_mining import Words, chunk_bounds, chunk_dictionary, collocations

TEXT = "lang string, text string"


def plain(rows, longest=5, least=100, share=100, top=2000):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    known = {k: n for k, n in counts.items() if n >= least}
    found = collections.defaultdict(list)
    for (lang, *words), a in known.items():
        if len(words) < 2:
            continue
        inside = [
            n
            for other, n in known.items()
            if other[0] == lang
            and len(other) > len(words) + 1
            and any(list(other[i : i + len(words)]) == words for i in range(1, len(other)))
        ]
        if any(100 * n >= share * a for n in inside):
            continue
        cuts = [
            (1000 * a * totals[lang] // (known[lang, *words[:k]] * known[lang, *words[k:]]), k) for k in range(1, len(words))
        ]
        score, k = min(cuts)
        entry = (" ".join(words), a, known[lang, *words[:k]], known[lang, *words[k:]], totals[lang], score)
        found[lang].append((-score, -a, entry[0].encode(), entry))
    return sorted((lang, rank, *e[3]) for lang, es in found.items() for rank, e in enumerate(sorted(es)[:top], 1))


@pytest.fixture(scope="module")
def texts():
    random.seed(13)
    vocabulary = ["the", "The", "of", "new", "york", "é", "漢字", "a|b", "x y", "city"]
    passage = "New York city of the , new york  city\tof the! old é 漢字 é 漢字. the the the the the the the"
    rows = [("en" if k % 3 else None, passage + " ".join(random.choices(vocabulary, k=40))) for k in range(60)]
    rows += [("de", passage)] * 30 + [("d e", passage)] * 30 + [("und", "new york city")] * 9
    rows += [("en", None), ("en", ""), (None, " \t.\r\n"), ("en", "the " * 3000), ("xx", "only a few")]
    rows += [("en", "q" * 70_000 + " " + "one\x0btwo\x0cthree\rfour " * 2000)]
    return rows


@pytest.mark.parametrize("least,share,top", [(25, 100, 2000), (10, 60, 7)])
def test_equals_counting_every_phrase(spark, texts, least, share, top):
    df = spark.createDataFrame(texts, TEXT).withColumns(
        {c: F.lit("clash") for c in ("chunk", "copies", "hash", "a", "n", "held", "doc_id", "key")}
    )
    got = sorted(map(tuple, collocations(df, least=least, share=share, top=top, every=5).collect()))
    want = plain(texts, least=least, share=share, top=top)
    assert got == want and len(want) > 20


def test_full_filters_change_nothing(spark, texts, monkeypatch):
    df = spark.createDataFrame(texts, TEXT)
    monkeypatch.setattr(KeyFilter, "may_hold", lambda self, hashes: np.ones(len(hashes), bool))
    got = phrase_mining.frequent_phrases(chunk_dictionary(df), least=25)
    n = got.count()
    monkeypatch.undo()
    assert n == phrase_mining.frequent_phrases(chunk_dictionary(df, every=3), least=25).count() > 0


def test_chunks_own_each_word_once(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefg.", k=rng.randrange(0, 700))).replace(".", "\n").encode() for _ in range(20)]
    texts += [b"", b"\n \n", b"a " * 1000]
    words = Words(texts)
    first, end, carried = chunk_bounds(words, 5, 24, 256)
    assert first[0] == 0 and end[-1] == len(words) and (first[1:] == end[:-1]).all()
    assert (end - first).max() <= 256 and (end > first).all()
    for s, e, c in zip(first, end, carried):
        assert words.text[s] == words.text[e - 1]
        follow = [i for i in range(e, min(e + 4, len(words))) if words.piece[i] == words.piece[e - 1]]
        assert c == e + len(follow)
    # A passage is cut alike behind other words.
    passage = b" ".join(b"w%d" % rng.randrange(200) for _ in range(400))
    cut = [Words([head + passage]) for head in (b"", b"six seven eight ")]
    tails = [
        {w.raw[w.starts[s] : w.ends[c - 1]] for s, _, c in zip(*chunk_bounds(w, 5, 24, 256))} for w in cut
    ]
    assert len(tails[0] & tails[1]) >= len(tails[0]) - 1 > 5


def test_filters_hold_their_keys(spark):
    keys = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 9000)
    df = spark.createDataFrame([(int(k),) for k in keys], "hash long")
    for most in (1 << 29, 1 << 16):
        limited = type("Limited", (KeyFilter,), {"MOST_BITS": most})
        held = limited.of(df)
        assert held.may_hold(keys.view(np.uint64)).all() and held.keys == 9000
        others = held.may_hold((keys + 1).view(np.uint64)).mean()
        assert others < (0.01 if most > 1 << 20 else 0.5)
        held.free()


def test_empty_tables(spark):
    none = spark.createDataFrame([], TEXT)
    assert collocations(none).count() == 0
    assert collocations(spark.createDataFrame([("en", "a b c")], TEXT)).count() == 0


@pytest.mark.parametrize("longest,passes", [(1, 1), (2, 2), (3, 3), (5, 3)])
def test_longer_phrases_are_counted_in_one_pass(spark, texts, monkeypatch, longest, passes):
    kept, whole = [], phrase_mining.stored
    monkeypatch.setattr(phrase_mining, "stored", lambda df, label: kept.append(label) or whole(df, label))
    dictionary = chunk_dictionary(spark.createDataFrame(texts, TEXT), every=5)
    got = phrase_mining.frequent_phrases(dictionary, longest, least=25).collect()
    assert len(kept) == 1 + passes
    assert all(r.size == len(r.phrase.split(" ")) for r in got) and {r.size for r in got} == set(range(1, longest + 1))


@pytest.mark.parametrize("longest", [1, 2, 5])
def test_rare_phrases_do_not_travel_as_texts(spark, texts, monkeypatch, longest):
    kept, whole = [], phrase_mining.stored
    monkeypatch.setattr(phrase_mining, "stored", lambda df, label: kept.append(df) or whole(df, label))
    dictionary = chunk_dictionary(spark.createDataFrame(texts, TEXT), every=5)
    phrase_mining.frequent_phrases(dictionary, longest, least=25)
    hashed, spelled = kept[1:-1], kept[-1]
    assert all(df.dtypes == [("hash", "bigint")] for df in hashed) and len(hashed) == min(longest, 3) - 1
    assert "phrase" in spelled.columns and "hash" not in spelled.columns


def test_rows_of_the_shuffles_are_short(spark, texts, monkeypatch):
    """Short hashes, language and phrase as one text, closely packed files, few tasks that repeat what is frequent."""
    dictionary = chunk_dictionary(spark.createDataFrame(texts, TEXT), every=5)
    files = [f.split("file:")[-1] for f in dictionary.inputFiles()]
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    seen, whole = [], type(dictionary).mapInArrow
    monkeypatch.setattr(
        type(dictionary), "mapInArrow", lambda self, f, schema, *a: seen.append((schema, whole(self, f, schema, *a))) or seen[-1][1]
    )
    found = phrase_mining.frequent_phrases(dictionary, 5, least=25)
    hashed = [df for schema, df in seen if schema == "hash long, a long"]
    assert all(0 <= r.hash < 1 << 40 for r in hashed[0].select("hash").collect())
    assert [schema for schema, _ in seen if schema.startswith("spoken")] == ["spoken string, a long"]
    assert "d e" in {r.lang for r in found.select("lang").collect()}
    many = dictionary.repartition(400)
    assert phrase_mining._fewer(many, 1).rdd.getNumPartitions() <= 400
    assert phrase_mining._fewer(many, 10**9).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_languages_with_line_ends_keep_their_phrases(spark):
    rows = [("a\nb", "one two"), ("", "one two"), ("\n", "one two")]
    got = phrase_mining.frequent_phrases(chunk_dictionary(spark.createDataFrame(rows * 4, TEXT)), least=4).collect()
    want = [(lang, p, 4, n) for lang in ("a\nb", "", "\n") for p, n in (("one", 1), ("two", 1), ("one two", 2))]
    assert sorted((r.lang, r.phrase, r.a, r.size) for r in got) == sorted(want)
