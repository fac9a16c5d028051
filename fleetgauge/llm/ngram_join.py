"""Similarity join of documents on sets of word n-grams, by T-occurrence search.

Equal sets are one class. Under one order of all shingles, two sets of sufficient Jaccard similarity
share at least L shingles among their first few, where L is a part of the smaller set. So each class
puts its first shingles into inverted lists, and a class's candidates are those that occur often
enough in its lists. As in DivideSkip, a few of the longest lists of a class, fewer than it must share,
are set aside: what occurs in the short ones is merged and counted, and the long ones are only probed
for what that leaves. Lists of equal members are one list with a weight.

A class too many of whose lists are long for the whole corpus goes to a further search of such
classes alone, with what is frequent among them last in the order. Once such classes are few enough for
it, all of them are compared in full, block by block. What still has only long lists otherwise is nearly
equal to very many classes: neighbours in its lists are verified, components are built, and
only pairs of components that share enough are left. Candidates are verified on their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import KeyFilter, given_columns, id_and_text, keyed_rows, member_filter, stored
from fleetgauge.llm.graph import components, contracted

#: A list with more members is long for the corpus.
LONG = 128
#: A task that meets a shingle this often deals it out by member.
HOT = 1000
#: So many classes a task remembers, in order not to send them twice.
REMEMBERED = 200_000
#: Sets are verified against blocks of about this many bytes of sets.
BLOCK_BYTES = 2_000_000
#: A crowd of at most so many bytes of sets is compared in full, by blocks of about so many.
CROWD_BYTES, CROWD_BLOCK_BYTES = 32_000_000, 4_000_000
_MIX = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93],
    np.uint64,
)


def shingles(text: str, width: int) -> np.ndarray:
    """The distinct hashes of a text's word n-grams, ascending; A-Z count as a-z."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    coded = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = max(1, len(words) - width + 1)
    mixed = np.full(count, min(width, len(words)), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(width, len(words))):
            mixed = (mixed ^ coded[j : j + count]) * _MIX[j % len(_MIX)]
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def class_of(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes(), seed=1) - (1 << 63)


class Likeness:
    """Jaccard of at least percent / 100, in whole numbers."""

    def __init__(self, percent: int, share: float = 0.1):
        self.percent, self.share = percent, share

    def least_size(self, n):
        """The smallest set that can be similar to one of n: percent * n <= 100 * size."""
        return -(-self.percent * n // 100)

    def overlap(self, n, m):
        """percent * (n + m - x) <= 100 * x"""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def must_share(self, n):
        """Shingles that similar sets have in common among their first ones, by the smaller size."""
        return np.maximum(1, np.ceil(self.share * n - 1e-9)).astype(np.int64)

    def prefix(self, n: int) -> int:
        return min(n, n - self.least_size(n) + int(self.must_share(np.int64(n))))

    def needed(self, n, m):
        """Shared shingles among the first ones that a pair needs at least to reach the overlap."""
        larger, smaller = np.maximum(n, m), np.minimum(n, m)
        return np.maximum(1, self.overlap(n, m) - self.least_size(larger) + self.must_share(smaller))


def t_occurrence(lists: list[np.ndarray], weights: list[int], need: int) -> tuple[np.ndarray, np.ndarray]:
    """Members that the weighted lists hold ``need`` times or more, and how often; lists are ascending.

    The longest lists whose weights stay below ``need`` are set aside; the others are merged and
    counted, and what may still reach ``need`` is looked up in the long ones by binary search.
    """
    order = sorted(range(len(lists)), key=lambda k: -len(lists[k]))
    aside, weight = [], 0
    for k in order[: max(0, len(order) - 1)]:
        if weight + weights[k] >= need or len(lists[k]) < 8:
            break
        aside.append(k)
        weight += weights[k]
    rest = [k for k in order if k not in set(aside)]
    merged = np.concatenate([lists[k] for k in rest])
    each = np.repeat([weights[k] for k in rest], [len(lists[k]) for k in rest])
    members, place = np.unique(merged, return_inverse=True)
    counts = np.bincount(place, weights=each, minlength=len(members)).astype(np.int64)
    kept = counts >= need - weight
    members, counts = members[kept], counts[kept]
    for k in aside:
        at = np.minimum(np.searchsorted(lists[k], members), len(lists[k]) - 1)
        counts = counts + weights[k] * (lists[k][at] == members)
    kept = counts >= need
    return members[kept], counts[kept]


def _arrow(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v, t) for k, (v, t) in columns.items()})


def _inverted_lists(postings: DataFrame) -> DataFrame:
    """members, sizes, long: lists of two members or more; long ones come in pieces with their shingle.

    ``postings``: token, cid, n, hot. A hot token is dealt by member and known to be long. Where it may
    be hot in one task and not in another, a row of n = 0 says so to the members that aren't dealt out.
    """

    def group(batches):
        held: list[np.ndarray] = []

        def close(rows: np.ndarray, last: bool):
            """Whole tokens of sorted rows; the last token waits for the next batch unless all is read."""
            if not len(rows):
                return None, rows
            starts = np.flatnonzero(np.r_[True, rows["token"][1:] != rows["token"][:-1]])
            stops = np.r_[starts[1:], len(rows)]
            keep = rows[starts[-1] :] if not last else rows[:0]
            if not last:
                starts, stops = starts[:-1], stops[:-1]
            out = {"token": [], "members": [], "sizes": [], "long": []}
            hot = np.logical_or.reduceat(rows["hot"], starts) if len(starts) else []
            for a, b, known in zip(starts.tolist(), stops.tolist(), hot):
                if b - a < 2 and not known:
                    continue
                own = rows[a:b][rows["n"][a:b] > 0]
                cid, first = np.unique(own["cid"], return_index=True)
                size = own["n"][first]
                if len(cid) < 2 and not known:
                    continue
                long = bool(known) or len(cid) > LONG
                for at in range(0, len(cid), LONG):
                    out["token"].append(int(rows["token"][a]) if long else 0)
                    out["members"].append(cid[at : at + LONG])
                    out["sizes"].append(size[at : at + LONG])
                    out["long"].append(long)
            made = _arrow(
                token=(out["token"], pa.int64()),
                members=(out["members"], pa.list_(pa.int64())),
                sizes=(out["sizes"], pa.list_(pa.int64())),
                long=(out["long"], pa.bool_()),
            )
            return made, keep

        kind = np.dtype([("token", np.int64), ("cid", np.int64), ("n", np.int64), ("hot", bool)])
        rest = np.zeros(0, kind)
        for batch in batches:
            rows = np.empty(batch.num_rows, kind)
            for k, name in enumerate(kind.names):
                rows[name] = batch.column(k).to_numpy(zero_copy_only=False)
            rest = np.concatenate([rest, rows])
            made, rest = close(rest, False)
            if made is not None:
                yield made
        made, _ = close(rest, True)
        if made is not None:
            yield made

    # A hot token's rows carry no group: they are long wherever they land. Its mark, with cid 0, lands
    # where the rows of tasks lie for which it isn't hot.
    dealt = postings.repartition(F.xxhash64("token", F.when(F.col("hot"), F.pmod("cid", F.lit(4096))).otherwise(0)))
    sorted_ = dealt.sortWithinPartitions("token", "cid").select("token", "cid", "n", "hot")
    schema = "token long, members array<long>, sizes array<long>, long boolean"
    return stored(sorted_.mapInArrow(group, schema), "inverted-lists")


def _candidates(lists: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that may be similar, and the classes (cid, n) whose short lists don't suffice."""
    in_long = stored(
        lists.filter("long")
        .select(F.explode(F.arrays_zip("members", "sizes")).alias("x"))
        .groupBy(F.col("x.members").alias("cid"), F.col("x.sizes").alias("n"))
        .agg(F.count(F.lit(1)).alias("longs")),
        "long-lists-of",
    )

    def spread(batches):
        """A row per member with the members at least as large that it can be similar to."""
        for batch in batches:
            whose, sizes, others, their, weights = [], [], [], [], []
            for members, n, weight in zip(*(batch.column(k) for k in range(3))):
                m, s, w = np.array(members.as_py()), np.array(n.as_py()), weight.as_py()
                order = np.lexsort((m, s))
                m, s = m[order], s[order]
                upto = np.searchsorted(like.least_size(s), s, side="right")
                for k in range(len(m)):
                    if upto[k] > k + 1:
                        whose.append(m[k])
                        sizes.append(s[k])
                        others.append(m[k + 1 : upto[k]])
                        their.append(s[k + 1 : upto[k]])
                        weights.append(w)
            yield _arrow(
                cid=(whose, pa.int64()),
                n=(sizes, pa.int64()),
                others=(others, pa.list_(pa.int64())),
                sizes=(their, pa.list_(pa.int64())),
                weight=(weights, pa.int64()),
            )

    listed = lists.filter("not long").groupBy("members", "sizes").agg(F.count(F.lit(1)).alias("weight"))
    rows = listed.mapInArrow(spread, "cid long, n long, others array<long>, sizes array<long>, weight long")
    none = F.expr("cast(array() as array<bigint>)")
    longs = in_long.select("cid", "n", none.alias("others"), none.alias("sizes"), F.col("longs").alias("weight"))

    def search(batches):
        here, size, aside, lists_, weights, size_of = None, 0, 0, [], [], {}

        def found():
            if not lists_:
                return [], []
            larger = np.array(sorted(set(size_of.values())))
            least = int(np.min(like.needed(np.int64(size), larger)))
            members, counts = t_occurrence(lists_, weights, max(1, least - aside))
            theirs = np.array([size_of[x] for x in members.tolist()], np.int64)
            kept = members[counts + aside >= like.needed(np.int64(size), theirs)] if len(members) else members
            return [here] * len(kept), kept.tolist()

        for batch in batches:
            a, b = [], []
            for cid, n, others, sizes, weight in zip(*(c.to_pylist() for c in batch.columns)):
                if cid != here:
                    x, y = found()
                    a += x
                    b += y
                    here, size, aside, lists_, weights, size_of = cid, n, 0, [], [], {}
                if not others:
                    aside += weight
                    continue
                order = np.argsort(others)
                lists_.append(np.array(others, np.int64)[order])
                weights.append(weight)
                size_of.update(zip(others, sizes))
            yield _arrow(a=(a, pa.int64()), b=(b, pa.int64()))
        x, y = found()
        yield _arrow(a=(x, pa.int64()), b=(y, pa.int64()))

    both = rows.unionByName(longs).repartition("cid").sortWithinPartitions("cid")
    pairs = stored(both.mapInArrow(search, "a long, b long"), "candidates")
    # A similar pair shares must_share(smaller) shingles; fewer long lists than that can't hide it.
    least = F.greatest(F.ceil(like.share * like.percent / 100 * F.col("n") - F.lit(1e-9)), F.lit(1))
    return pairs, stored(in_long.filter(F.col("longs") >= least).select("cid", "n"), "all-long")


class Corpus:
    """The sets of a document table, computed from the texts whenever they are read."""

    def __init__(self, rows: DataFrame, width: int):
        self.rows, self.width = rows.withColumn("text_key", F.xxhash64("text")), width

    def classes(self, like: Likeness) -> DataFrame:
        """doc_id, text_key, n_shingles, cid, first: cid is null for empty sets, and ``first`` holds a class's
        first shingles in the order of their hashes, as packed longs, where a task meets it first."""
        width = self.width

        def make(batches):
            seen: set[int] = set()
            for ids, texts, keys in pieces(batches):
                sets = [shingles(x, width) for x in texts.to_pylist()]
                cids = [class_of(x) if len(x) else None for x in sets]
                first = []
                for cid, found in zip(cids, sets):
                    new = cid is not None and cid not in seen
                    first.append(found[: like.prefix(len(found))].tobytes() if new else None)
                    if new:
                        seen.add(cid)
                if len(seen) > REMEMBERED:
                    seen = set()
                yield pa.record_batch(
                    [
                        ids,
                        keys,
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array(cids, pa.int64()),
                        pa.array(first, pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "cid", "first"],
                )

        schema = "doc_id long, text_key long, n_shingles long, cid long, first binary"
        return self.rows.mapInArrow(make, schema)

    def postings(self, like: Likeness) -> DataFrame:
        return postings(self.classes(like))

    def sets(self, classes: DataFrame, wanted: DataFrame) -> DataFrame:
        """cid, found: the sets of the classes of a column ``cid``, as packed longs, and a few others.

        One text of each class is looked for by its hash, so that no other text is cut into words. Each
        class comes once. ``classes``: the rows of ``classes()``, stored.
        """
        width = self.width
        one = classes.filter("cid is not null").select("cid", "text_key")
        one = one.join(wanted.select("cid"), "cid", "left_semi").groupBy("cid").agg(F.min("text_key").alias("text_key"))
        named = KeyFilter.of(one.select("text_key"))

        def make(batches):
            seen: set[int] = set()
            for _, texts, keys in pieces(batches):
                known = keys.to_numpy()
                out = {}
                for k in np.flatnonzero(named.may_hold(known.view(np.uint64))).tolist():
                    if (key := int(known[k])) in seen:
                        continue
                    seen.add(key)
                    found = shingles(texts[k].as_py(), width)
                    if len(found):
                        out[class_of(found)] = found.tobytes()
                if len(seen) > REMEMBERED:
                    seen = set()
                yield _arrow(cid=(list(out), pa.int64()), found=(list(out.values()), pa.binary()))

        return self.rows.mapInArrow(make, "cid long, found binary").dropDuplicates(["cid"])


def pieces(batches):
    """The columns of at most 1024 rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield batch.slice(at, 1024).columns


def postings(classes: DataFrame) -> DataFrame:
    """token, cid, n, hot of the first shingles of ``Corpus.classes``.

    Each flush of a task judges by itself what is hot, and adds a row (token, 0, 0, true) for it.
    """

    def make(batches):
        tokens, cids, sizes, held = [], [], [], 0

        def flush():
            token = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            known, place, counts = np.unique(token, return_inverse=True, return_counts=True)
            each = [len(x) for x in tokens]
            marks = known[counts >= HOT]
            none = np.zeros(len(marks), np.int64)
            return _arrow(
                token=(np.concatenate([token, marks]), pa.int64()),
                cid=(np.concatenate([np.repeat(np.array(cids, np.int64), each), none]), pa.int64()),
                n=(np.concatenate([np.repeat(np.array(sizes, np.int64), each), none]), pa.int64()),
                hot=(np.concatenate([counts[place] >= HOT, none == 0]), pa.bool_()),
            )

        for batch in batches:
            for cid, n, first in zip(*(c.to_pylist() for c in batch.columns)):
                tokens.append(np.frombuffer(first, np.int64))
                cids.append(cid)
                sizes.append(n)
                held += len(tokens[-1])
                if held > 1_500_000:
                    yield flush()
                    tokens, cids, sizes, held = [], [], [], 0
        yield flush()

    rows = classes.filter("first is not null").select("cid", "n_shingles", "first")
    return rows.mapInArrow(make, "token long, cid long, n long, hot boolean")


def _bytes(sets: DataFrame) -> int:
    return sets.agg(F.sum(F.length("found").cast("long")).alias("bytes")).first()["bytes"] or 0


def _placed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, block_a, block_b: the blocks in which the pairs' sets meet.

    Blocks hold some BLOCK_BYTES of sets. Classes whose smallest partner is the same are mostly partners of
    each other, so they go to one block while they take a small part of it, and else each by its own hash.
    """
    held = _bytes(sets)
    blocks = F.lit(held // BLOCK_BYTES + 1)
    one, two = pairs.select(F.col("a").alias("cid"), "b"), pairs.select(F.col("b").alias("cid"), F.col("a").alias("b"))
    ends = one.unionByName(two).groupBy("cid").agg(F.min("b").alias("b"))
    sized = ends.select("cid", F.least("cid", "b").alias("label")).join(
        sets.select("cid", F.length("found").cast("long").alias("bytes")), "cid", "left"
    )
    sized = stored(sized, "partners")
    groups = sized.groupBy("label").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") <= BLOCK_BYTES // 8)
    homes = sized.select("cid", "label").join(groups.select("label"), "label").select("cid", F.col("label").alias("home"))
    out = pairs.select("a", "b")
    for side in "ab":
        named = homes.select(F.col("cid").alias(side), F.col("home").alias(f"home_{side}"))
        block = F.pmod(F.xxhash64(F.coalesce(f"home_{side}", side)), blocks)
        out = out.join(named, side, "left").withColumn(f"block_{side}", block).drop(f"home_{side}")
    return stored(out.select("a", "b", "block_a", "block_b"), "placed-pairs")


def _verified(sets_of: Callable[[DataFrame], DataFrame], pairs: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. ``sets_of`` gives the sets of wanted classes, and may give others.

    Classes are dealt into blocks, those of one neighbourhood into one. A set travels once for each pair of
    blocks that holds partners of it, not once for each partner; a task holds the sets of two blocks at a time.
    """
    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    sets = sets_of(ends)
    placed = _placed(pairs, sets)
    asking = placed.select("block_a", "block_b", F.col("a").alias("cid"), F.col("b").alias("partner"))
    none = F.lit(None).cast("long").alias("partner")
    asked = placed.select("block_a", "block_b", F.col("b").alias("cid"), none)
    # At most the classes of one block are partners here.
    each = asking.unionByName(asked).groupBy("cid", "block_a", "block_b").agg(F.collect_set("partner").alias("partners"))
    rows = each.join(sets.select("cid", "found"), "cid").select("block_a", "block_b", "cid", "partners", "found")
    met = rows.repartition("block_a", "block_b").sortWithinPartitions("block_a", "block_b")

    def check(batches):
        here, held, asked = None, {}, []

        def similar():
            a, b = [], []
            for cid, partners in asked:
                x = held[cid]
                for other in partners:
                    y = held[other]
                    common = np.intersect1d(x, y, assume_unique=True).size
                    if common >= like.overlap(len(x), len(y)):
                        a.append(cid)
                        b.append(other)
            return _arrow(a=(a, pa.int64()), b=(b, pa.int64()))

        for batch in batches:
            one, two, cids, partners, found = batch.columns
            places = zip(one.to_pylist(), two.to_pylist(), cids.to_pylist())
            for k, (block_a, block_b, cid) in enumerate(places):
                if (block_a, block_b) != here:
                    yield similar()
                    here, held, asked = (block_a, block_b), {}, []
                held[cid] = np.frombuffer(found[k].as_py(), np.int64)
                if others := partners[k].as_py():
                    asked.append((cid, others))
        yield similar()

    return stored(met.mapInArrow(check, "a long, b long"), "links")


def _all_pairs(sets: DataFrame, held_bytes: int, like: Likeness) -> DataFrame:
    """Links (u, v) that join what similarity joins among sets of at most CROWD_BYTES together.

    Every two blocks of sets meet in one group, where each set's shared shingles with all others are
    counted from inverted lists. A group gives no more links than it has sets.
    """
    blocks = held_bytes // CROWD_BLOCK_BYTES + 1
    own = F.pmod(F.xxhash64("cid"), F.lit(blocks))
    every = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    dealt = sets.select("cid", "found", own.alias("own")).withColumn("other", F.explode(every))
    dealt = dealt.select(
        F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"), "own", "cid", "found"
    )
    met = dealt.repartition("block_a", "block_b").sortWithinPartitions("block_a", "block_b")

    def links(cids, sides, founds):
        sizes = np.array([len(x) for x in founds])
        order = np.argsort(sizes, kind="stable")  # what is similar in size lies together
        cids, sides, sizes = cids[order], sides[order], sizes[order]
        founds = [founds[k] for k in order.tolist()]
        tokens = np.concatenate(founds)
        token, place = np.unique(tokens, return_inverse=True)
        holder = np.repeat(np.arange(len(cids)), sizes)
        by_token = np.argsort(place, kind="stable")
        holders, edges = holder[by_token], np.searchsorted(place[by_token], np.arange(len(token) + 1))
        at, whole = np.concatenate([[0], np.cumsum(sizes)]), len(np.unique(sides)) < 2
        least = np.searchsorted(sizes, like.least_size(sizes))
        for k in range(len(cids)):
            lists = [holders[edges[x] : edges[x + 1]] for x in place[at[k] : at[k + 1]].tolist()]
            lists = [x[: np.searchsorted(x, k)] for x in lists]
            first = int(least[k])
            shared = np.concatenate(lists)
            counts = np.bincount(shared[shared >= first] - first, minlength=k - first)
            near = counts >= like.overlap(sizes[k], sizes[first:k])
            if not whole:
                near &= sides[first:k] != sides[k]
            if len(found := cids[first:k][near]):
                yield pa.record_batch([pa.array(np.full(len(found), cids[k])), pa.array(found)], names=["a", "b"])

    def check(batches):
        here, cids, sides, founds = None, [], [], []

        def joined():
            if len(cids) > 1:
                yield from contracted(links(np.array(cids, np.int64), np.array(sides, np.int64), founds))

        for batch in batches:
            one, two, own, cid, found = batch.columns
            for k, place in enumerate(zip(one.to_pylist(), two.to_pylist())):
                if place != here:
                    yield from joined()
                    here, cids, sides, founds = place, [], [], []
                cids.append(cid[k].as_py())
                sides.append(own[k].as_py())
                founds.append(np.frombuffer(found[k].as_py(), np.int64))
        yield from joined()

    return stored(met.mapInArrow(check, "u long, v long").select(F.col("u").alias("a"), F.col("v").alias("b")), "links")


def _rare_first(sets: DataFrame, like: Likeness) -> DataFrame:
    """Postings of the first shingles, those that many of these sets hold coming last.

    The order needs to be one for all sets, not exact: what is frequent is told by a filter of fixed size.
    """

    def members(batches):
        for batch in batches:
            packed = b"".join(batch.column(0).to_pylist())
            token, n = np.unique(np.frombuffer(packed, np.int64), return_counts=True)
            yield _arrow(token=(token, pa.int64()), n=(n, pa.int64()))

    each = sets.select("found").mapInArrow(members, "token long, n long")
    counted = stored(each.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > LONG), "frequent")
    frequent = member_filter(counted.select("token"))
    very = member_filter(counted.filter(F.col("n") > HOT).select("token"))

    def postings(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                tokens, cids, sizes, hot = [], [], [], []
                for cid, packed in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    found = np.frombuffer(packed, np.int64).tolist()
                    first = sorted(found, key=lambda x: (frequent(x), x))[: like.prefix(len(found))]
                    tokens += first
                    cids += [cid] * len(first)
                    sizes += [len(found)] * len(first)
                    hot += [very(x) for x in first]
                yield _arrow(
                    token=(tokens, pa.int64()), cid=(cids, pa.int64()), n=(sizes, pa.int64()), hot=(hot, pa.bool_())
                )

    return sets.select("cid", "found").mapInArrow(postings, "token long, cid long, n long, hot boolean")


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    parts = components(links).select(F.col("node").alias("cid"), "component")
    return rows.join(parts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))


def ngram_links(corpus: Corpus, classes: DataFrame, like: Likeness, levels: int = 3) -> DataFrame:
    """Links (a, b) between classes that join exactly the classes which similarity joins.

    ``classes``: the rows of ``corpus.classes``, stored.
    """
    pairs, crowd = _candidates(_inverted_lists(postings(classes)), like)
    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
    # One reading of the texts for the pairs at hand and for the searches to come.
    sets = stored(corpus.sets(classes, ends.unionByName(crowd.select("cid")).distinct()), "sets")
    links = _verified(lambda ends: sets, pairs, like)
    if crowd.isEmpty():
        return links
    lists, before = None, None
    for level in range(levels + 1):  # what is frequent is judged anew among fewer
        within = stored(sets.join(crowd.select("cid"), "cid", "left_semi"), "crowd-sets")
        held = _bytes(within)
        if held <= CROWD_BYTES:
            return links.unionByName(_all_pairs(within, held, like))
        if level == levels or before is not None and held > 0.7 * before:
            break
        before = held
        lists = _inverted_lists(_rare_first(within, like))
        pairs, crowd = _candidates(lists, like)
        links = links.unionByName(_verified(lambda ends: within, pairs, like))
    rows = lists.filter("long").select("token", F.explode(F.arrays_zip("members", "sizes")).alias("x"))
    rows = rows.select("token", F.col("x.members").alias("cid"), F.col("x.sizes").alias("n"))
    rows = stored(rows.join(crowd.select("cid"), "cid", "left_semi"), "crowded")

    def neighbours(batches):
        for batch in batches:
            token, n, cid = (c.to_numpy() for c in batch.columns)
            near = (token[1:] == token[:-1]) & (n[:-1] >= like.least_size(n[1:])) & (cid[1:] != cid[:-1])
            yield _arrow(a=(cid[:-1][near], pa.int64()), b=(cid[1:][near], pa.int64()))

    chained = rows.repartitionByRange("token", "n", "cid").sortWithinPartitions("token", "n", "cid")
    chain = chained.select("token", "n", "cid").mapInArrow(neighbours, "a long, b long").distinct()
    links = stored(links.unionByName(_verified(lambda ends: within, chain, like)), "links")
    # A pair that no short list decided shares long ones only, and as many as any pair needs. So
    # components that share too few hold no similar pair; others are paired in full and counted.
    known = stored(_labelled(rows.drop("component"), links), "crowded")
    sizes = known.groupBy("component").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    each = known.select("token", "component").distinct().join(sizes, "component")
    one = each.select("token", F.col("component").alias("ca"), F.col("low").alias("la"), F.col("high").alias("ha"))
    two = each.select("token", F.col("component").alias("cb"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    sizes_meet = (like.percent * F.col("la") <= 100 * F.col("hb")) & (like.percent * F.col("lb") <= 100 * F.col("ha"))
    low, high = F.least("la", "lb"), F.greatest("ha", "hb")
    near = (
        one.join(two, (one.token == two.token) & (F.col("ca") < F.col("cb")) & sizes_meet)
        .groupBy("ca", "cb", low.alias("low"), high.alias("high"))
        .agg(F.count(F.lit(1)).alias("both"))
        # Over all sizes of the two, the fewest shared shingles are needed at the ends of their range.
        .filter(F.col("both") >= F.greatest(_share(like, F.col("low")), _needed(like, F.col("low"), F.col("high")) - 2))
    )
    near = stored(near.select("ca", "cb"), "near-components")
    left = known.select("token", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    right = known.select("token", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    fits = (F.lit(like.percent) * F.greatest("na", "nb")) <= 100 * F.least("na", "nb")
    rest = stored(
        left.join(near, "ca")
        .join(right, ["token", "cb"])
        .filter(fits)
        .groupBy("a", "b", "na", "nb")
        .agg(F.count(F.lit(1)).alias("both"))
        .filter(F.col("both") >= _needed(like, F.least("na", "nb"), F.greatest("na", "nb")))
        .select("a", "b", "both"),
        "crowded-pairs",
    )
    # The likeliest partners of each class first: pairs that they join need no look at their sets.
    for partners in (2, 4, 8):
        likeliest = Window.partitionBy("a").orderBy(F.desc("both"), "b")
        best = rest.withColumn("rank", F.row_number().over(likeliest)).filter(F.col("rank") <= partners)
        links = stored(links.unionByName(_verified(lambda ends: within, best.select("a", "b"), like)), "links")
        parts = _labelled(known.select("cid").distinct(), links)
        ends = [parts.select(F.col("cid").alias(k), F.col("component").alias(f"c{k}")) for k in "ab"]
        apart = rest.join(ends[0], "a").join(ends[1], "b").filter("ca <> cb")
        rest = stored(apart.select("a", "b", "both"), "crowded-pairs")
        if rest.isEmpty():
            return links
    return links.unionByName(_verified(lambda ends: within, rest.select("a", "b"), like))


def _share(like: Likeness, n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(like.share) * n - F.lit(1e-9)))


def _needed(like: Likeness, smaller: Column, larger: Column) -> Column:
    """``Likeness.needed`` as a column."""
    overlap = F.ceil(F.lit(like.percent) * (smaller + larger) / (100 + like.percent))
    return F.greatest(F.lit(1), overlap - F.ceil(F.lit(like.percent) * larger / 100) + _share(like, smaller))


def ngram_components(
    docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size per row; component_id is the smallest doc_id reachable.

    Words are runs of bytes other than ASCII white space, A-Z as a-z; a text with fewer than ``width``
    words is one shingle; without words the set is empty and linked with nothing, and component_id is the
    row's own doc_id. Documents of equal sets always link. A row that repeats another, or an id, is one
    more document; a null id has a component like others but is never its name, and where it is alone
    component_id is null. A table without rows gives no rows; other columns are not read. Shingles and
    sets are known by 64-bit hashes.
    """
    rows = id_and_text(docs, id_col, text_col)
    like, corpus = Likeness(percent), Corpus(rows, width)
    found = stored(corpus.classes(like), "classes")
    members = found.select("doc_id", "n_shingles", "cid")
    classes = members.filter("cid is not null").groupBy("cid").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("class_size")
    )
    labelled = stored(_labelled(classes, ngram_links(corpus, found, like)), "class-components")
    names = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.join(names, "component").select("cid", "component_id", "class_size")
    # Rows are dealt by (class, salt): a class may hold a third of them.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")
    copies = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    full = members.filter("cid is not null").withColumn("_salt", salt).join(copies, ["cid", "_salt"])
    columns = ["doc_id", "n_shingles", "component_id", "class_size"]
    empty = members.filter("cid is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size")
    )
    return full.select(columns).unionByName(empty)


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component one row stays, whole.

    Rows are known by a digest of id and text, and the row of the smallest digest stays. Rows that
    repeat id and text are copies as well; texts without words have no copies but such rows.
    """
    keyed = keyed_rows(docs)
    groups = ngram_components(keyed.select("_key", F.col("_text").alias("text")), width, percent, "_key")
    stays = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_key"))
    kept = keyed.join(stored(stays, "stays"), "_key", "left_semi").dropDuplicates(["_key"])
    return kept.select(given_columns(docs, F.col("_text")))
