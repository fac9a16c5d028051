"""Archives, preferences, neighbours, secrets, quality and the pipeline."""

import base64
import collections
import gzip
import hashlib
import io
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import compare, connect
from fleetgauge.catalog.registry import Query
from fleetgauge.llm import queries, secrets, warc
from fleetgauge.llm.nearest import nearest_by_inner_product
from fleetgauge.llm.preferences import echoed_answers, preference_pairs
from fleetgauge.llm.quality import Network, echoes, fit, quality_scores
from tests.llm.conftest import FOLDER, documents


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    query = Query(name, (), lambda t: queries.QUERIES[name](t.spark, t.folder), queries.SQL[name])
    rows, problem = compare(spark, connect(FOLDER), query, FOLDER)
    assert problem is None, problem
    assert rows > 0


def test_archives_round_trip(spark):
    pages = [
        (1, None, None),
        (2, "u", ""),
        (3, "u", "é" * 700),
        (4, "u", "é" * 700),
        (4, "u", "é" * 700),
        (None, "u", "é" * 700),
        (5, "u v\n", "a\r\n\r\nb" * 900),
        (6, "u", "x" * 999),
        (7, "u", "x" * 999),
        (8, "u", "WARC/1.1\r\n\r\n" * 400_000),
        (9, "u", "A" * 1500),
        (10, "u", "A" * 1500),
        (10, "u", "short"),
        (10, "u", "B" * 1700),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha1", F.lit("clash"))
    by = collections.defaultdict(list)
    for page, _, html in pages:
        by[html or ""].append(page)
    want = []
    for page, _, html in pages:
        raw = (html or "").encode()
        largest = max((x for x in by[html or ""] if x is not None), default=None)
        revisit = len(raw) >= 1000 and page is not None and page < largest
        kind = ("revisit", largest) if revisit else ("response", None)
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), *kind))
    got = sorted(map(tuple, warc.warc_round_trip(df, per_archive=3000).collect()), key=str)
    assert got == sorted(want, key=str)
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_normaliser_makes_members_that_stand_alone():
    payloads = [b"", b"one", b"two" * 100_000]
    digest = hashlib.sha1(b"").hexdigest()
    made = [warc.record(k, "u", p, digest, "response", None, "2000-01-01T00:00:00Z") for k, p in enumerate(payloads)]
    target = io.BytesIO()
    index = list(warc.normalise(io.BytesIO(gzip.compress(b"".join(made))), target, 6))
    raw = target.getvalue()
    assert sum(length for _, length, _ in index) == len(raw)
    for (offset, length, name), whole in zip(index, made):
        assert gzip.decompress(raw[offset : offset + length]) == whole
        assert name in whole.decode()
    assert base64.b32encode(bytes.fromhex(digest)) in made[0]


def test_preferences_share_their_prompt(spark):
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (1, 2, "user", "more"), (2, 0, "user", None), (None, 0, "user", "x")]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (2, 0, "user", ""), (3, 0, "assistant", "alone")]
    columns = "pair_id long, turn long, role string, text string"
    extra = spark.createDataFrame(chosen, columns).withColumn("copy", F.lit("clash"))
    rows = preference_pairs(extra, spark.createDataFrame(rejected, columns)).collect()
    got = sorted((r.pair_id, r.part, r.turn, r.header + r.body, r.trained) for r in rows)
    assert got == [
        (1, "chosen", 1, "<|assistant|>\ngood\n", True),
        (1, "chosen", 2, "<|user|>\nmore\n", False),
        (1, "prompt", 0, "<|user|>\nq\n", False),
        (1, "rejected", 1, "<|assistant|>\nbad\n", True),
        (2, "prompt", 0, "<|user|>\n\n", False),
        (3, "rejected", 0, "<|assistant|>\nalone\n", True),
    ]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference_pairs(*echoed_answers(empty)).count() == 0


def odd_turns():
    """Rows of conversations: long, sparse, repeated, without an answer, on one side, null in each column."""
    turns = [1, 1, 2, 3, 15, 16, 17, 100, -5, 2**62, None]
    rows = [
        (pair, turns[(pair * 7 + k * 3) % 11], ["user", "assistant", "system", None][(pair + k * k) % 4], f"t{(pair * k) % 5}")
        for pair in range(150)
        for k in range(pair % 9)
    ]
    rows += [(500, k, "assistant" if k % 2 else "user", f"long {k % 3}") for k in range(1500)]
    rows += [(501, 0, "user", "first"), (501, 700, "assistant", "last"), (501, 900, "user", "after")]
    rows += [(502, 0, "user", None), (502, 1, "assistant", "a"), (503, 0, None, "b"), (503, 0, "user", "a")]
    rows += [(503, 0, "user", None), (503, 4, "assistant", None), (503, 4, "assistant", "x"), (503, 4, None, "y")]
    return rows + [(None, 0, "user", "x"), (504, None, "user", "x"), *rows[100:140]]


def pairs_of(chosen, rejected):
    """What ``preference_pairs`` must return, from rows in lists."""
    sides = [collections.defaultdict(lambda: collections.defaultdict(list)) for _ in range(2)]
    for side, rows in zip(sides, (chosen, rejected)):
        for pair, turn, role, text in rows:
            if pair is not None and turn is not None:
                side[pair][turn].append((role or "", text or ""))
    for pair in {*sides[0], *sides[1]}:
        both = [{turn: sorted(said) for turn, said in side[pair].items()} for side in sides]
        end = min((t for t in {*both[0], *both[1]} if both[0].get(t) != both[1].get(t)), default=None)
        for name, side in zip(("chosen", "rejected"), both):
            for turn, said in side.items():
                common = end is None or turn < end
                for copy, (role, text) in enumerate([] if common and name == "rejected" else said, 1):
                    part = "prompt" if common else name
                    trained = not common and role == "assistant"
                    yield pair, part, turn, copy, role, f"<|{role}|>\n", f"{text}\n", trained


def echoes_of(rows):
    """What ``echoed_answers`` must return, from rows in a list."""
    rows = [r for r in rows if r[0] is not None and r[1] is not None]
    chosen, rejected = [], []
    for pair in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == pair]
        last = max((r[1] for r in own if r[2] == "assistant"), default=None)
        opening = min((r[3] for r in own if r[1] == min(x[1] for x in own) and r[3] is not None), default=None)
        own = [r for r in own if last is None or r[1] <= last]
        chosen += own
        rejected += [(*r[:3], opening if r[1] == last and r[2] == "assistant" else r[3]) for r in own]
    return chosen, rejected


@pytest.fixture
def joins_by_shuffle(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for key, value in kept.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_preferences_of_odd_turns(spark, joins_by_shuffle, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    rows = odd_turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    chosen, rejected = echoed_answers(df)
    want = echoes_of(rows)
    assert collections.Counter(map(tuple, chosen.collect())) == collections.Counter(want[0])
    assert collections.Counter(map(tuple, rejected.collect())) == collections.Counter(want[1])
    got = preference_pairs(chosen, rejected).collect()
    assert sorted(map(tuple, got)) == sorted(pairs_of(*want))
    # Sides that come from elsewhere and are dealt otherwise.
    other = [(p, t, r, "z" if t == 16 else x) for p, t, r, x in rows if p != 500 or t < 1400]
    columns = "pair_id int, turn int, role string, text string"
    sides = [[r for r in side if r[1] != 2**62] for side in (rows, other)]
    got = preference_pairs(*(spark.createDataFrame(side, columns) for side in sides)).collect()
    assert sorted(map(tuple, got)) == sorted(pairs_of(*sides))


def test_preferences_deal_each_text_once(spark, joins_by_shuffle):
    """One exchange of all turns and one of the openings; the other four hold a few numbers a pair."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = queries.op3_preferences(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"[-+] Exchange ", plan)) == 6
    assert len(re.findall(r"FileScan parquet .*text", plan)) == 1


def test_neighbours_reach_their_recall(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, (600, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors.astype(np.float32))]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] + [1.0] * 15), (2080, [1.0]), (None, rows[3][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("cell", F.lit("clash"))
    got = nearest_by_inner_product(df, df.filter("vec_id % 20 = 0"), block=200).collect()
    ids, matrix = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == {i for i, _ in rows if i % 20 == 0}
    hits = 0
    for query, list_ in found.items():
        scores = (matrix * matrix[ids == query][0]).sum(axis=1)
        order = [k for k in np.lexsort((ids, -scores)) if ids[k] != query][:20]
        hits += len({int(ids[k]) for k in order} & {v for v, _ in list_})
        assert len(list_) == 20 and query not in [v for v, _ in list_]
        assert list_ == sorted(list_, key=lambda x: (-x[1], x[0]))
        for vec, score in list_:
            assert abs(scores[ids == vec][0] - score) < 1e-12
    assert hits >= 0.9 * 20 * len(found)
    few = df.filter("vec_id < 5")
    assert nearest_by_inner_product(few, few.filter("vec_id = 0")).count() == 4
    assert nearest_by_inner_product(df.limit(0), df.limit(0)).count() == 0


def test_secrets_are_found_and_masked(spark, docs, none):
    words = "the of and thouer tion onanthe erhawhtionandthe aaaaaaaaaaaaaaaaaaaa 4556737586899855".split()
    keys = [hashlib.sha256(str(k).encode()).hexdigest()[:40] for k in range(40)]
    texts = {
        700_000 + k: f"{' '.join(words)} token = \"{key}\" and {words[k % 5]} 汉 AKIA{key[:16].upper()}"
        for k, key in enumerate(keys)
    }
    df = documents(spark, list(texts.items())).unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    found = [r for r in secrets.secret_findings(df).collect() if r.doc_id in texts]
    assert len(found) == 40 * 5
    for r in found:
        value = texts[r.doc_id][r.place : r.place + r.length]
        assert hashlib.sha256(value.encode()).hexdigest() == r.value_sha256
        assert r.is_secret == (value in keys or value.startswith("AKIA")), value
    clean = secrets.redacted(df)
    assert clean.columns == df.columns and clean.count() == df.count()
    masked = {r.doc_id: r.text for r in clean.collect() if r.doc_id in texts}
    for k, key in enumerate(keys):
        text = masked[700_000 + k]
        assert key not in text and "AKIA" not in text and text.startswith(" ".join(words))
    assert clean.filter("doc_id = 900001").first().text is None
    assert secrets.secret_findings(none).count() == 0


def test_assigned_secrets_of_any_form_are_found(spark, docs):
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(40)]
    long = [base64.b64encode(k).decode()[:40].replace("=", "x") for k in keys]
    short = [base64.b64encode(k).decode()[:9].replace("/", "a") + "r5" for k in keys]
    signs = [f"{x[:5]}.!{x[5:9]}@$~{x[9:]}7" for x in short]
    texts, places = {}, collections.defaultdict(dict)
    for k in range(40):
        text = f"汉 export AWS_SECRET_ACCESS_KEY={long[k]}\ndatabase_password: {signs[k]}\npassword = \"{short[k]}\" thou"
        texts[800_000 + k] = text
        for value in (long[k], signs[k], short[k]):
            places[800_000 + k][text.index(value)] = value
    df = documents(spark, list(texts.items())).unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    cut = {(r.doc_id, r.place): r for r in secrets.candidates(df).collect() if r.doc_id in texts}
    for (doc, place), r in cut.items():
        text, ends = texts[doc], place + len(r.value)
        assert text[place:ends] == r.value
        assert r.before == text[max(0, place - 40) : place] and r.after == text[ends : ends + 20]
    found = {(r.doc_id, r.place): r for r in secrets.secret_findings(df).collect() if r.doc_id in texts}
    assert set(found) == set(cut)
    for doc in texts:
        for place, value in places[doc].items():
            assert cut[doc, place].value == value
            assert found[doc, place].says_secret == 1 and found[doc, place].is_secret, value
        name = found[doc, texts[doc].index("AWS_SECRET")]
        assert name.says_secret == 0 and not name.is_secret
    masked = {r.doc_id: r.text for r in secrets.redacted(df).collect() if r.doc_id in texts}
    want = '汉 export AWS_SECRET_ACCESS_KEY=[SECRET]\ndatabase_password: [SECRET]\npassword = "[SECRET]" thou'
    assert set(masked.values()) == {want}


def test_tables_without_sure_secrets_keep_their_texts(spark):
    texts = ["see /usr/share/doc/readme-first/index ERSCHSCHBERBERTZ", "snake_case_word_of_text_1 and " + "0a1B" * 6]
    clean = documents(spark, list(enumerate(texts)))
    found = secrets.secret_findings(clean).collect()
    assert len(found) == 4 and not any(r.is_secret for r in found)
    assert {r.doc_id: r.text for r in secrets.redacted(clean).collect()} == dict(enumerate(texts))
    # Secrets alone teach no forest either, and are told by their form.
    sure = documents(spark, [(1, "AKIA" + "AB12" * 4)])
    assert secrets.redacted(sure).first().text == secrets.MASK


def test_quality_learns_what_labels_mark(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality_scores(docs, labels.withColumn("text", F.lit("clash"))).join(labels, "doc_id").collect()
    good = np.array([r.score for r in rows if r.held_out and r.quality == 1])
    bad = np.array([r.score for r in rows if r.held_out and r.quality == 0])
    assert np.mean(good[:, None] > bad[None, :]) > 0.9 and (good >= 0.3).mean() > 0.95
    one = quality_scores(docs, labels.filter("quality = 1")).collect()
    assert len(one) == docs.count() and all(r.predicted == 1 for r in one)
    assert quality_scores(docs.limit(0), labels.limit(0)).count() == 0


def test_network_reads_whole_texts():
    texts = ["the cat sat on the mat " * 3 + str(k) for k in range(40)]
    junk = [t.upper() for t in texts]
    net = fit(texts + junk, [1] * 40 + [0] * 40, 0.5, filters=8)
    assert isinstance(net, Network) and net.score(texts[0]) > 0.5 > net.score(junk[0])
    data = np.frombuffer((texts[0] * 2500).encode(), np.uint8)
    whole = np.maximum((net.windows(data, echoes(data)) @ net.filters).max(axis=0) + net.bias, 0)
    assert np.allclose(net.answers(data), whole, atol=1e-4)
    assert 0 <= net.score("") <= 1


def test_pipeline_stages(spark):
    documents_ = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = documents_
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == documents_.columns, name
        counts.append(docs.count())
    assert documents_.count() > counts[0] > counts[1] == counts[2] == counts[3]
    assert docs.filter(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0
    assert docs.filter("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == counts[3]
    assert public_tokenizers.path("byte_bpe_50k.json") == queries.TOKENIZER


def test_stages_keep_columns_of_any_name(spark, docs):
    names = ["_key", "_spans", "_kept", "_row", "_text", "_salt", "a.b"]
    odd = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, odd, FOLDER)
        assert out.columns == odd.columns, name
        wrong = [F.col(f"`{c}`") != F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names]
        kept = out.select("doc_id", F.greatest(*[F.coalesce(w, F.lit(False)) for w in wrong]).alias("w")).collect()
        assert len(kept) > 100 and not any(r.w for r in kept), name
        assert stage(spark, odd.limit(0), FOLDER).count() == 0
