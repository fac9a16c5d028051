"""N-gram join, suffix arrays and paragraph sketches against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import fleetgauge.llm.ngram_join as join
import fleetgauge.llm.suffix_dedup as suffix
from fleetgauge.llm.graph import components
from fleetgauge.llm.paragraph_sketch import document_fingerprints
from tests.llm.conftest import documents


def similar_groups(rows, width=4, percent=85):
    sets = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        grams = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
        sets.append(grams)
    holders = collections.defaultdict(list)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, grams in enumerate(sets):
        counts = collections.Counter(j for g in grams for j in holders[g])
        for j, both in counts.items():
            if 100 * both >= percent * (len(grams) + len(sets[j]) - both):
                parent[root(i)] = root(j)
        for g in grams:
            holders[g].append(i)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[root(i)] = min(names.get(root(i), doc), doc)
    return sorted(((doc, len(sets[i]), names.get(root(i))) for i, (doc, _) in enumerate(rows)), key=str)


def joined(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in join.ngram_components(df).collect()), key=str)


def test_ngram_join(docs, rows, none):
    assert joined(docs) == similar_groups(rows)
    assert joined(none) == []


def test_ngram_join_with_crowded_lists(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base, hot = [rng.choice(words) for _ in range(60)], [rng.choice(words) for _ in range(15)]
    rows = []
    for i in range(80):
        text = list(base)
        for _ in range(1 + i % 2):
            text[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    for i in range(60):
        text = [rng.choice(words) for _ in range(20)]
        rows.append((1000 + i, " ".join(text[:10] + hot + text[10:])))
        if i % 3 == 0:
            rows.append((3000 + i, " ".join(["q", *text[1:10], *hot, *text[10:]])))
    rows += [(5000 + i, " ".join(rng.choice(words[:5]) for _ in range(rng.randint(0, 8)))) for i in range(100)]
    monkeypatch.setattr(join, "LONG", 8)
    monkeypatch.setattr(join, "HOT", 40)
    assert joined(documents(spark, rows)) == similar_groups(rows)


def test_ngram_join_of_a_group_that_is_hot_in_one_task_only(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10_000)}" for _ in range(200)]
    rows = []
    for i in range(50):
        text = list(base)
        text[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(text)))
    monkeypatch.setattr(join, "LONG", 16)
    monkeypatch.setattr(join, "HOT", 30)
    one, two = (spark.sparkContext.parallelize(part, 1) for part in (rows[:42], rows[42:]))
    two_tasks = spark.createDataFrame(one.union(two), "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        dealt = join.Corpus(two_tasks, 4).postings(join.Likeness(85))
        lists = join._inverted_lists(dealt)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shared = {t: n for t, n in collections.Counter(r.token for r in dealt.filter("n > 0").collect()).items() if n > 42}
    held = collections.Counter()
    for r in lists.filter("long").collect():
        held[r.token] += len(r.members)
        assert all(n > 0 for n in r.sizes)
    assert len(shared) > 20 and shared == {t: held[t] for t in shared}


def test_t_occurrence_counts_weighted_lists():
    rng = random.Random(1)
    for _ in range(200):
        lists = [np.array(sorted(rng.sample(range(40), rng.randint(1, 30)))) for _ in range(rng.randint(1, 8))]
        weights = [rng.randint(1, 4) for _ in lists]
        need = rng.randint(1, 10)
        counts = collections.Counter()
        for members, weight in zip(lists, weights):
            counts.update({int(m): weight for m in members})
        want = {m: c for m, c in counts.items() if c >= need}
        members, found = join.t_occurrence(lists, weights, need)
        assert dict(zip(members.tolist(), found.tolist())) == want


def test_one_of_each_group_stays(spark, docs):
    kept = join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(set(left)) == len(left)
    names = [name for doc, n, name in similar_groups(left, 5, 80) if n]
    assert len(set(names)) == len(names)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 240)] + [(1, 1), (3, 2)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[k] for k in range(100, 141)} == {100}
    assert {got[k] for k in [7, *range(200, 240)]} == {7}
    assert got[3] == got[2] == 2


def without_repeats(rows, length=200):
    raws = [(doc, (text or "").encode()) for doc, text in rows]
    counts = collections.Counter()
    for _, raw in raws:
        counts.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for doc, raw in raws:
        covered = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if counts[raw[i : i + length]] > 1:
                covered[i : i + length] = True
        kept = bytes(b for b, gone in zip(raw, covered) if not gone)
        runs = int((covered[1:] < covered[:-1]).sum())
        out.append((doc, len(raw), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_order_sorts_suffixes():
    rng = random.Random(1)
    for _ in range(200):
        text = [rng.randint(1, 3) for _ in range(rng.randint(1, 60))]
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffix.suffix_order(np.array(text), 1000).tolist() == want


def test_suffix_array_dedup(docs, rows, none):
    small = [r for r in rows if len(r[1] or "") < 8000]
    part = docs.filter("coalesce(length(text), 0) < 8000")
    assert sorted(map(tuple, suffix.suffix_array_dedup(part).collect()), key=str) == without_repeats(small)
    assert suffix.suffix_array_dedup(none).count() == 0


@pytest.mark.parametrize("crowd, stretch", [(5, 1 << 19), (2000, 256)])
def test_suffix_array_dedup_of_a_hot_passage(spark, monkeypatch, crowd, stretch):
    rng = random.Random(crowd)
    letters = "abcdefgh "

    def noise(n):
        return "".join(rng.choice(letters) for _ in range(n))

    hot = noise(260)
    rows = [
        (i, noise(rng.randint(0, 300)) + hot[rng.randint(0, 30) : 260 - rng.randint(0, 30)] + noise(150))
        for i in range(60)
    ]
    rows += [(100, "ab" * 300), (101, "z" * 201)]
    monkeypatch.setattr(suffix, "CROWD", crowd)
    monkeypatch.setattr(suffix, "STRETCH", stretch)
    got = suffix.suffix_array_dedup(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == without_repeats(rows)


def test_cut_texts_keep_their_columns(spark, docs):
    cut = suffix.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() >= docs.count() - 2
    assert cut.filter("doc_id = 900005").first().text == ""


def test_fingerprints(spark, docs, none):
    def lines(text):
        return {x for x in text.split("\n") if x}

    def likeness(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    long = documents(spark, [(800001, "\n".join(f"line {k}" for k in range(1500))), (800002, "\n\na\n\na\nb")])
    given = docs.select("doc_id", "text").unionByName(long.select("doc_id", "text"))
    ordered = given.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tie", F.xxhash64("text"))
    rows = ordered.orderBy(F.asc_nulls_first("doc_id"), "tie").collect()
    want = []
    for k, r in enumerate(rows):
        other, half = rows[(k + 1) % len(rows)].text, len(r.text) // 2
        edited = r.text[: len(r.text) - half] + other[:half]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        near = likeness(lines(r.text), lines(edited)), likeness(lines(r.text), lines(other))
        want.append((r.doc_id, len(r.text), digest, *near))
    found = document_fingerprints(given).collect()
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({r.fingerprint for r in found if r.doc_id == 900004}) == 1
    assert document_fingerprints(none).count() == 0


def test_pairs_are_verified_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10_000)}" for _ in range(100)]
    sets = {}
    for i in range(60):
        text = list(base)
        for _ in range(rng.randrange(6)):
            text[rng.randrange(100)] = f"x{rng.randrange(40)}"
        sets[i] = join.shingles(" ".join(text), 4)
    table = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "cid long, found binary")
    every = [(a, b) for a in sets for b in sets if a < b]
    pairs = spark.createDataFrame(every, "a long, b long")
    monkeypatch.setattr(join, "BLOCK_BYTES", 5_000)
    found = join._verified(lambda ends: table.join(ends, "cid", "left_semi"), pairs, join.Likeness(85))
    both = {(a, b): len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in every}
    wanted = [p for p, x in both.items() if 100 * x >= 85 * (len(sets[p[0]]) + len(sets[p[1]]) - x)]
    assert 0 < len(wanted) < len(every)
    assert sorted((r.a, r.b) for r in found.collect()) == sorted(wanted)


def _crowd(sets_of, texts):
    sets = {i: sets_of(x, 4) for i, x in enumerate(texts)}
    parent = list(range(len(texts)))
    for a in sets:
        for b in range(a):
            both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                old, new = parent[a], parent[b]
                parent = [new if x == old else x for x in parent]
    return sets, parent


def test_a_crowd_is_joined_without_a_row_for_each_pair(spark, monkeypatch):
    rng = random.Random(9)
    texts = []
    for size in (40, 90, 91):
        base = [f"w{rng.randrange(10_000)}" for _ in range(size)]
        for _ in range(40):
            text = list(base)
            for _ in range(rng.randrange(6)):
                text[rng.randrange(size)] = f"x{rng.randrange(40)}"
            texts.append(" ".join(text))
    sets, parent = _crowd(join.shingles, texts)
    table = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "cid long, found binary")
    for block in (10**9, 9_000):
        monkeypatch.setattr(join, "CROWD_BLOCK_BYTES", block)
        links = [(r.a, r.b) for r in join._all_pairs(table, join._bytes(table), join.Likeness(85)).collect()]
        assert len(links) < (len(texts) if block > 9_000 else 200 * len(texts))
        got = list(range(len(texts)))
        for a, b in links:
            old, new = got[a], got[b]
            got = [new if x == old else x for x in got]
        assert len(set(zip(got, parent))) == len(set(got)) == len(set(parent)) > 3


@pytest.mark.parametrize("most", [0, 10**9])
def test_crowds_are_searched_in_levels_or_in_full(spark, monkeypatch, most):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(90):
        text = list(base)
        for _ in range(1 + i % 4):
            text[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    monkeypatch.setattr(join, "LONG", 8)
    monkeypatch.setattr(join, "HOT", 40)
    monkeypatch.setattr(join, "CROWD_BYTES", most)
    searched, search = [], join._rare_first
    monkeypatch.setattr(join, "_rare_first", lambda *given: searched.append(1) or search(*given))
    assert joined(documents(spark, rows)) == similar_groups(rows)
    assert bool(searched) == (most == 0)


def test_partners_meet_in_one_block(spark, monkeypatch):
    monkeypatch.setattr(join, "BLOCK_BYTES", 4000)
    clusters = [range(k * 1000, k * 1000 + 6) for k in range(40)]
    pairs = [(a, b) for c in clusters for a in c for b in c if a < b]
    pairs += [(a, b) for a in range(90_000, 90_040) for b in range(a + 1, 90_040)]  # takes more than a part of a block
    sets = [(cid, bytes(80)) for cid in {x for p in pairs for x in p}]
    placed = join._placed(
        spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(sets, "cid long, found binary")
    ).collect()
    assert sorted((r.a, r.b) for r in placed) == sorted(pairs)
    met = {}
    for r in placed:
        for cid in (r.a, r.b):
            met.setdefault(cid, set()).add((r.block_a, r.block_b))
    assert all(len(met[x]) == 1 for c in clusters for x in c)
    assert max(len(met[x]) for x in range(90_000, 90_040)) > 1
