"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch has cells in three parts; each distinct paragraph's digest is added to one cell of each
part, which keeps a count, the xor of digests and the xor of their check values. Two sketches of one
shape subtract cell by cell; what both texts hold cancels. Cells left with a single digest are
peeled, which frees others, until every differing digest is recovered or no cell is single. Then the
sketches of both texts are made anew, larger: digests are dealt over as many sketches as both texts'
paragraphs ask for, and those of sketches that still fail are dealt again with other hashes.

A paragraph is a line. A text without line breaks is one digest, so one changed character makes its
likeness 0: near copies of one-line texts are lost.

Only built-in functions run; a text's work is linear in its paragraphs but for dealing them out.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import stored

#: Cells of the printed fingerprint and of each sketch of later attempts, in thirds.
BASE_THIRD, LATER_THIRD = 4, 8
#: Paragraphs of both texts for each sketch of later attempts.
PER_SKETCH = 6
ROUNDS = 12
#: What a text is compared with.
OTHERS = ("edited", "next")
_CELL = "named_struct('n', {n}, 'k', {k}, 'h', {h})"


def _prepared(keys: str, seed: int, third: int) -> str:
    """Each digest with its check value and its cell in each part."""
    cell = ", ".join(
        f"'{part}', cast({j * third} + pmod(xxhash64(k, {seed}, {j}), {third}) as int)"
        for j, part in enumerate("abc")
    )
    return f"transform({keys}, k -> named_struct('k', k, 'h', xxhash64(k, -1), {cell}))"


def _sketch(keys: str, seed: int, third: int) -> str:
    zero = _CELL.format(n="0", k="0L", h="0L")
    added = _CELL.format(n="s.n + 1", k="s.k ^ x.k", h="s.h ^ x.h")
    return (
        f"transform(array({_prepared(keys, seed, third)}), p -> transform(sequence(0, {3 * third - 1}), i -> "
        f"aggregate(filter(p, x -> x.a = i or x.b = i or x.c = i), {zero}, (s, x) -> {added})))[0]"
    )


def _difference(a: str, b: str) -> str:
    taken = _CELL.format(n="x.n - y.n", k="x.k ^ y.k", h="x.h ^ y.h")
    return f"zip_with({a}, {b}, (x, y) -> {taken})"


def _peeled(cells: str, seed: int, third: int) -> str:
    """How many digests the difference of two sketches holds; null where peeling gets stuck."""
    single = "filter(s.cells, x -> abs(x.n) = 1 and xxhash64(x.k, -1) = x.h)"
    places = ", ".join(
        f"'{part}', cast({j * third} + pmod(xxhash64(x.k, {seed}, {j}), {third}) as int)"
        for j, part in enumerate("abc")
    )
    pure = f"array_distinct(transform({single}, x -> named_struct('n', x.n, 'k', x.k, 'h', x.h, {places})))"
    removed = _CELL.format(n="c.n - x.n", k="c.k ^ x.k", h="c.h ^ x.h")
    step = (
        f"transform(array({pure}), p -> if(size(p) = 0, s, named_struct('cells', transform(s.cells, (cell, i) -> "
        f"aggregate(filter(p, x -> x.a = i or x.b = i or x.c = i), cell, (c, x) -> {removed})), "
        "'found', s.found + size(p))))[0]"
    )
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'found', 0), (s, r) -> {step}, "
        "s -> if(forall(s.cells, x -> x.n = 0 and x.k = 0 and x.h = 0), s.found, null))"
    )


def _dealt(keys: str, parts: str, seed: int) -> str:
    """Digests dealt over ``parts`` squared lists, in two steps so that no list is read for each other."""
    inner = (
        f"transform(sequence(0, {parts} - 1), v -> filter(w, k -> pmod(shiftright(xxhash64(k, {seed}, 8), 20), {parts}) = v))"
    )
    outer = f"filter({keys}, k -> pmod(xxhash64(k, {seed}, 8), {parts}) = u)"
    return f"flatten(transform(sequence(0, {parts} - 1), u -> transform(array({outer}), w -> {inner})[0]))"


def _attempt(a: str, b: str, seed: int) -> str:
    """Counts the differing digests of two key lists by many small sketches.

    A struct of the count and of what is in sketches that can't be peeled, for the next attempt.
    """
    parts = f"cast(ceil(sqrt({seed} * (size({a}) + size({b})) / {PER_SKETCH}D)) as int)"
    third = LATER_THIRD
    pairs = f"arrays_zip({_dealt(a, 'parts', seed)}, {_dealt(b, 'parts', seed)})"
    one = _peeled(_difference(_sketch("z['0']", seed, third), _sketch("z['1']", seed, third)), seed, third)
    found = f"transform({pairs}, z -> named_struct('n', {one}, 'a', z['0'], 'b', z['1']))"
    left = "flatten(transform(filter(d, x -> x.n is null), x -> x.{side}))"
    result = (
        "named_struct('n', aggregate(d, 0, (s, x) -> s + coalesce(x.n, 0)), "
        f"'a', {left.format(side='a')}, 'b', {left.format(side='b')})"
    )
    return f"transform(array(greatest({parts}, 1)), parts -> transform(array({found}), d -> {result})[0])[0]"


def _first_attempt(a: str, b: str) -> str:
    """The smallest sketch, which the fingerprint prints; then larger ones."""
    small = _peeled(_difference(_sketch(a, 0, BASE_THIRD), _sketch(b, 0, BASE_THIRD)), 0, BASE_THIRD)
    none = f"slice({a}, 1, 0)"
    done = f"named_struct('n', v, 'a', {none}, 'b', {none})"
    return f"transform(array({small}), v -> if(v is not null, {done}, {_attempt(a, b, 1)}))[0]"


def _next_attempt(state: str, seed: int) -> str:
    again = _attempt(f"{state}.a", f"{state}.b", seed)
    more = f"transform(array({again}), y -> named_struct('n', y.n + {state}.n, 'a', y.a, 'b', y.b))[0]"
    return f"if(size({state}.a) + size({state}.b) = 0, {state}, {more})"


def _likeness(a: str, b: str, differing: str) -> str:
    """Jaccard likeness of two sets from their sizes and the size of their symmetric difference."""
    sizes = f"(size({a}) + size({b}))"
    return f"if({sizes} = 0, 1D, ({sizes} - {differing}) / cast({sizes} + {differing} as double))"


def paragraph_digests(text: Column) -> Column:
    """The distinct digests of the lines of a text that are not empty, ascending."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))))


def fingerprint(keys: str) -> Column:
    """The cells of the smallest sketch as text, after the number of distinct paragraphs."""
    cells = f"transform({_sketch(keys, 0, BASE_THIRD)}, c -> concat_ws('.', cast(c.n as string), hex(c.k), hex(c.h)))"
    return F.expr(f"concat_ws(':', cast(size({keys}) as string), {cells})")


def with_next(docs: DataFrame, per_block: int = 20_000) -> DataFrame:
    """Each document with the text of the next one by ascending id; the first follows the last.

    Ids are cut into blocks by approximate quantiles; texts move once, to their block, and a block's
    last document gets the first text of the next block from a table with a row per block. Rows that
    share an id follow one another by a digest of their text; null ids come first.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_order"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    total = rows.count()
    blocks = total // per_block + 12
    shares = [k / blocks for k in range(1, blocks)]
    bounds = rows.agg(F.percentile_approx("_order", shares, 10 * blocks)).first()[0] or []
    splits = [-float("inf"), *sorted({float(x) for x in bounds}), float("inf")]
    if len(splits) == 2:
        splits.insert(1, 0.0)
    rows = rows.withColumn("_place", F.col("_order").cast("double"))
    rows = Bucketizer(splits=splits, inputCol="_place", outputCol="_block").transform(rows).drop("_place")

    ends = stored(rows.groupBy("_block").agg(F.min("_order").alias("low"), F.max("_order").alias("high")), "blocks")
    in_order = Window.orderBy("_block")  # one row per block
    chained = ends.select(
        "_block", "high", F.coalesce(F.lead("low").over(in_order), F.first("low").over(in_order)).alias("follows")
    )
    tie = F.xxhash64("text")
    ordered = Window.partitionBy("_block").orderBy("_order", tie)
    inside = rows.withColumn("next_text", F.lead("text").over(ordered)).filter("next_text is not null")

    def at_end(column: str, largest: bool) -> DataFrame:
        wanted = chained.select("_block", F.col(column).alias("_order"))
        key = ["_block", "_order"] if largest else ["_order"]
        found = rows.select("doc_id", "_block", "_order", "text")
        joined = found.join(wanted if largest else wanted.drop("_block").distinct(), key).withColumn("_tie", tie)
        rank = Window.partitionBy("_order").orderBy(F.desc("_tie") if largest else F.asc("_tie"))
        return joined.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank", "_tie")

    firsts = at_end("follows", False).select(F.col("_order").alias("follows"), F.col("text").alias("next_text"))
    lasts = at_end("high", True).join(chained.select("_block", "follows"), "_block").join(firsts, "follows")
    columns = ["doc_id", "text", "next_text"]
    return inside.select(columns).unionByName(lasts.select(columns))


def document_fingerprints(docs: DataFrame, most_attempts: int = 12) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has the last half of the text's code points replaced by the first as many of the
    next document. A likeness is that of the sets of distinct non-empty lines, from the number of
    digests that peeling recovers; two texts without lines are alike (1). A null text counts as empty;
    repeated rows and ids are documents of their own; a table without rows gives no rows; columns other
    than doc_id and text are not read. A pair that no attempt peels, which is as unlikely as equal
    digests of different lines, ends the query with an error.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half),
        F.substring(F.col("next_text"), F.lit(1), half),
    )
    keyed = stored(
        with_next(docs).select(
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            F.sha2(edited, 256).alias("edited_sha256"),
            paragraph_digests(F.col("text")).alias("own"),
            paragraph_digests(edited).alias("edited"),
            paragraph_digests(F.col("next_text")).alias("next"),
        ),
        "paragraph-digests",
    )
    # Spread, as the blocks of ids may be few and texts of one block long.
    first = keyed.repartition(F.xxhash64("doc_id", "edited_sha256"))
    first = first.select(
        "*",
        fingerprint("own").alias("fingerprint"),
        fingerprint("edited").alias("edited_fingerprint"),
        *(F.expr(_first_attempt("own", other)).alias(f"_{other}") for other in OTHERS),
    )
    current, done = stored(first, "fingerprints"), None
    open_ = " + ".join(f"size(_{other}.{side})" for other in OTHERS for side in "ab") + " > 0"
    for seed in range(2, most_attempts + 1):
        stuck = current.filter(open_)
        if stuck.isEmpty():
            break
        finished = current.filter(f"not ({open_})")
        done = finished if done is None else done.unionByName(finished)
        again = {f"_{other}": F.expr(_next_attempt(f"_{other}", seed)) for other in OTHERS}
        current = stored(stuck.withColumns(again), "fingerprints")
    failed = F.raise_error(F.lit("a pair of sketches could not be peeled"))
    whole = current if done is None else done.unionByName(current)
    near = {
        f"near_{other}": F.when(F.expr(open_), failed.cast("double")).otherwise(
            F.expr(_likeness("own", other, f"_{other}.n"))
        )
        for other in OTHERS
    }
    return whole.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        *(v.alias(k) for k, v in near.items()),
        *(F.col(f"_{other}.n").alias(f"{other}_differing") for other in OTHERS),
    )
