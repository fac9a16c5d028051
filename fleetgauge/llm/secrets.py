"""Secret scans: a loose pattern finds candidates, a random forest removes the false ones.

Candidates are runs of 16 or more characters that keys are made of, and values of six or more of any
characters that are assigned to a name of a secret. Such a value ends at its quote or, bare, at a quote,
angle bracket, comma or semicolon; neither kind holds white space. For each the scan takes its length,
how often the kind of character changes, how many kinds there are, how much of it frequent words of the
corpus cover, whether it looks like a path, and what words stand beside it. A forest
fitted on labelled findings gives the probability that a candidate is a secret. All steps are
built-in functions of Spark and its own forest.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import given_columns, keyed_rows

#: Words beside a candidate that speak for a secret, or for another meaning of a random string.
TELLS_SECRET = (
    r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|private.?key|auth|credential|bearer)"
)
TELLS_OTHER = r"(?i)(example|sample|dummy|test|hash|sha\d*|md5|commit|checksum|uuid|guid|digest|https?:|www\.)"
ASSIGNED = r"""[=:]>?\s*["']?$"""
#: Cheap looks back come first: few places follow a sign of assignment.
_NAMED = (
    r"""(?<=[=:>\s"'])(?<=[=:]>?\s{0,3}["']?)(?<="""
    + TELLS_SECRET.replace("(?i)(", "(?i:")
    + r"""[A-Za-z0-9_.-]{0,20}["']?\s{0,3}[=:]{1,2}>?\s{0,3}["']?)"""
)
_VALUE = r"""(?<=")[^"\s]{6,}(?=")|(?<=')[^'\s]{6,}(?=')|[^\s"'<>,;]{5,}[^\s"'<>,;.:?)\]}]"""
CANDIDATE = f"{_NAMED}(?![=:])(?:{_VALUE})|[A-Za-z0-9+/_-]{{16,}}"
#: Characters beside a candidate, whether they belong to other candidates or not. Candidates have
#: LEAST characters or more, so that these come from the nearest few.
LEAST = 6
BESIDE_BEFORE, BESIDE_AFTER = 40, 20
FEATURES = [
    "n_chars", "changes", "kinds", "digits", "uppers", "distinct", "covered", "path", "says_secret",
    "says_other", "assigned", "quoted",
]
MASK = "[SECRET]"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, source, place, value, before, after: one row per candidate; place counts code points from 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.split(text, CANDIDATE, -1).alias("_between"),
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("_found"),
    ).filter(F.size("_found") > 0)
    # Running places: what stood before each candidate, summed once per text.
    lengths = F.expr("transform(_found, (x, i) -> length(_between[i]) + length(x))")
    places = F.expr(
        "transform(aggregate(_lengths, named_struct('at', 0L, 'ends', cast(array() as array<bigint>)), "
        "(s, x) -> named_struct('at', s.at + x, 'ends', concat(s.ends, array(s.at + x)))).ends, "
        "(x, i) -> x - length(_found[i]))"
    )
    rows = found.withColumn("_lengths", lengths).withColumn("_places", places)
    back, ahead = -(-BESIDE_BEFORE // LEAST), -(-BESIDE_AFTER // LEAST)
    before = (
        f"right(concat(array_join(transform(slice(_found, greatest(i - {back}, 0) + 1, least(i, {back})), (y, j) -> "
        f"concat(right(_between[greatest(i - {back}, 0) + j], {BESIDE_BEFORE}), right(y, {BESIDE_BEFORE}))), ''), "
        f"right(_between[i], {BESIDE_BEFORE})), {BESIDE_BEFORE})"
    )
    after = (
        f"left(concat(left(_between[i + 1], {BESIDE_AFTER}), array_join(transform(slice(_found, i + 2, {ahead}), "
        f"(y, j) -> concat(left(y, {BESIDE_AFTER}), left(_between[i + j + 2], {BESIDE_AFTER}))), '')), {BESIDE_AFTER})"
    )
    each = F.expr(
        f"inline(transform(_found, (x, i) -> named_struct('place', _places[i], 'value', x, "
        f"'before', {before}, 'after', {after})))"
    )
    return rows.select("doc_id", each)


def frequent_words(docs: DataFrame, most: int = 300) -> list[str]:
    """The corpus's most frequent words of three to eight letters, over all documents."""
    words = docs.select(
        F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\b[a-z]{3,8}\b"), F.lit(0))).alias("word")
    )
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(most)
    return [r.word for r in top.collect()]  # at most ``most`` words


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    value, before = F.col("value"), F.col("before")
    length = F.length(value).cast("double")
    small = F.lower(value)
    known = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    uncovered = F.length(F.regexp_replace(small, known, "")) if words else F.length(small)
    kinds = ["[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"]
    changes = _count(value, r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]")
    flag = lambda column: F.coalesce(column, F.lit(False)).cast("double")
    return found.withColumns(
        {
            "n_chars": length,
            "changes": changes / length,
            "kinds": sum((flag(value.rlike(k)) for k in kinds), F.lit(0.0)),
            "digits": _count(value, "[0-9]") / length,
            "uppers": _count(value, "[A-Z]") / length,
            "distinct": F.size(F.array_distinct(F.split(value, ""))) / length,
            "covered": 1 - uncovered / length,
            "path": _count(value, "/") / length + flag(before.rlike(r"[/.]$")) + flag(F.col("after").rlike(r"^\.[a-z]")),
            "says_secret": flag(before.rlike(TELLS_SECRET)),
            "says_other": flag(before.rlike(TELLS_OTHER)),
            "assigned": flag(before.rlike(ASSIGNED)),
            "quoted": flag(before.rlike("[\"']$")) * flag(F.col("after").rlike("^[\"']")),
        }
    )


def form_label() -> Column:
    """1 or 0 for a finding whose form leaves no doubt, null for others.

    Issued keys with a fixed head, and values with digits that are assigned to a name of a secret, are
    secrets. Plain words, rules of one sign, bare numbers and digests named as such are not.
    """
    value, before = F.col("value"), F.col("before")
    named = before.rlike(TELLS_SECRET + r"""["']?\s*[=:]{1,2}>?\s*["']?$""") & value.rlike("[0-9]")
    issued = value.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk_(live|test)_[A-Za-z0-9]{16,}$")
    plain = value.rlike("^[A-Z]?[a-z]+([-_/][A-Za-z]?[a-z]+)*$|^[0-9+/_-]+$|^[A-Z]+([-_/][A-Z]+)*$")
    digest = before.rlike(r"(?i)(sha\d*|md5|commit|checksum|digest)[:=\s]+$")
    return F.when(issued | (named & ~plain), 1).when(plain | digest, 0)


def labelled_by_form(found: DataFrame) -> DataFrame:
    """Findings whose form leaves no doubt, with label 1 or 0; others are left out."""
    return found.withColumn("label", form_label()).filter("label is not null")


def fitted_forest(labelled: DataFrame, per_class: int = 3000, trees: int = 20, depth: int = 5, seed: int = 7):
    """A forest over at most ``per_class`` findings of each label, or None without both labels.

    ``labelled`` has the features and ``label``. The findings are the first by a hash of value and place.
    """
    order = F.xxhash64("value", "doc_id", "place")
    sample = None
    for label in (0, 1):
        part = labelled.filter(F.col("label") == label).orderBy(order, "doc_id", "place").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
        sample.select(*FEATURES, F.col("label").cast("double").alias("label"))
    )
    rows = rows.select("features", "label").repartition(4).persist()
    try:
        if rows.select("label").distinct().count() < 2:
            return None
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=32)
        return forest.fit(rows)
    finally:
        rows.unpersist()


def judged(found: DataFrame, forest) -> DataFrame:
    """Adds ``probability``. Without a forest, 1 for secrets by their form and 0 for what is undecided."""
    if forest is None:
        return found.withColumn("probability", F.when(form_label() == 1, 1.0).otherwise(0.0))
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep").transform(found)
    forest = forest.copy()
    forest.setFeaturesCol("_features").setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol(
        "_predicted"
    )
    answered = forest.transform(assembled)
    return answered.withColumn("probability", vector_to_array("_probability")[1]).drop(
        "_features", "_probability", "_raw", "_predicted"
    )


def secret_findings(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Every candidate with the forest's probability and ``is_secret``.

    ``labelled`` is a frame of labelled findings (doc_id, place, value, before, after, label); without
    one, findings of an unmistakable form in these documents teach the forest. A null text counts as
    empty and has no findings. Each row is scanned by itself, also where rows or ids repeat or an id is
    null; a table without rows gives none; columns other than doc_id and text are not read. The value
    itself is not returned but its digest.
    """
    words = frequent_words(docs)
    found = with_features(candidates(docs), words)
    teaching = labelled_by_form(found) if labelled is None else with_features(labelled, words)
    scored = judged(found, fitted_forest(teaching))
    return scored.select(
        "doc_id",
        "place",
        F.length("value").alias("length"),
        F.sha2("value", 256).alias("value_sha256"),
        "changes",
        "covered",
        "path",
        "says_secret",
        "probability",
        (F.col("probability") >= threshold).alias("is_secret"),
    )


def redacted(docs: DataFrame, threshold: float = 0.5, mask: str = MASK) -> DataFrame:
    """The documents with every value the forest takes for a secret replaced; other columns unchanged.

    Values are judged as in ``secret_findings``. Candidates are cut out of each text again and judged
    values are matched by document, text and place.
    """
    words = frequent_words(docs)
    found = with_features(candidates(docs), words)
    forest = fitted_forest(labelled_by_form(found))
    keyed = keyed_rows(docs)
    as_docs = keyed.select(F.col("_key").alias("doc_id"), F.col("_text").alias("text"))
    scored = judged(with_features(candidates(as_docs), words), forest).filter(F.col("probability") >= threshold)
    # A text holds few secrets for its length: their places gather beside the text they come from.
    spans = scored.groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct("place", F.length("value").cast("long").alias("length")))).alias("_spans")
    )
    joined = keyed.join(spans.withColumnRenamed("doc_id", "_key"), "_key", "left")
    pieces = F.expr(
        "concat_ws('', transform(_spans, (s, i) -> concat("
        "substring(_text, cast(if(i = 0, 1, _spans[i - 1].place + _spans[i - 1].length + 1) as int), "
        "cast(if(i = 0, s.place, s.place - _spans[i - 1].place - _spans[i - 1].length) as int)), "
        f"'{mask}')))"
    )
    tail = F.expr("substring(_text, cast(element_at(_spans, -1).place + element_at(_spans, -1).length + 1 as int))")
    clean = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(F.concat(pieces, tail))
    return joined.select(given_columns(docs, clean))
