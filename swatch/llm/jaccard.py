"""Exact Jaccard join of word n-gram sets, as a join in a metric space.

The sets live in the metric of the symmetric difference; a Jaccard similarity of at least t means
|x - y| + |y - x| <= (|x| + |y|) (1 - t) / (1 + t).  Pivots cut the space into regions, the triangle
inequality says which documents a region must also hold, and regions are joined on their own:

1. Copies collapse first: equal sets are one point, whose representative is the smallest id.
2. The first regions are parts of the sets.  The hash range is cut into as many parts for all sets of a size class, more than the
   n-grams that linked sets of the class differ in; so linked sets agree in some part, whole.  A point is replicated to the
   regions of its first apart + 1 parts in one fixed order (parts of fewer rare n-grams last, then by hash), where apart
   is the most that a set of its size differs from a linked one: that many suffice.  It goes to its own size class, and to the next one
   if linked sets may be there.  A part holds a few n-grams, so unrelated texts seldom share one, however many there are.
   A region of one point is done.
3. Small regions (``SMALL`` points) are compared inside a task by their sizes.
4. In large regions (groups of near copies, as any other region is thinned out by the order) points
   act as pivots: ``PIVOTS`` a round, ``ROUNDS`` rounds, from parts not yet connected.  All points within the
   threshold of a pivot are connected to it.  What then is left outside the main part of a region is
   compared exactly with the whole region, in blocks that never hold more than ``BLOCK`` x ``CHUNK`` points.
5. Candidates whose parity sketches allow a link are verified on their whole sets; links give components.

No pairs of a group are emitted: a group of m near copies gives about m links.  n-grams are compared
as 62-bit hashes; two different n-grams of one pair of documents collide with probability below 1e-12.

Texts: A-Z lower-cased, words between ASCII white space.  Fewer words than n are one n-gram; texts
without words (null, empty) have an empty set and link with nothing.  Rows that repeat an id are
points of that id.  Rows with a null id link like others; their component is the smallest id that they reach, null if there
is none.
"""

from __future__ import annotations

import bisect
import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swatch.llm.common import held, list_array, map_rows
from swatch.llm.components import components
from swatch.llm.ppm import _add_up
from swatch.session import materialize

WORDS, PERCENT = 3, 90
HOT_SHARE = 5e-4  # n-grams of so many documents come last in the order: at most mean set size / share of them
SMALL, PIVOTS, ROUNDS = 64, 8, 3
WIDTH = 3  # a size class is as wide as so many steps of linked sizes
BLOCK, CHUNK = 128, 512
ROWS_A_GROUP = 4000
BROADCAST_IDS = 4_000_000
BROADCAST_PAIRS, BROADCAST_GRAMS = 500_000, 4_000_000
WORD_ENTRIES = 200_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
RARE, RANK_SHIFT = 3, 59  # parts of so many rare n-grams come first
_STARTS: dict[int, list[int]] = {}


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) >= WORD_ENTRIES:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 62-bit hashes of the word n-grams."""
    words = (text or "").encode("utf-8").translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(held("words", _Hashes).__getitem__, words), np.uint64, len(words))
    if len(h) < n:
        h = np.concatenate([h, np.arange(1, n - len(h) + 1, dtype=np.uint64)])
    size = len(h) - n + 1
    acc = np.zeros(size, np.uint64)
    for k in range(n):
        acc = (acc ^ (acc >> np.uint64(29))) + h[k:k + size]
        acc *= _ODD[k % 3]
        acc ^= acc >> np.uint64(32)
    return np.unique((acc >> np.uint64(2)).astype(np.int64))


def hot_grams(docs: DataFrame, text_col: str, n: int, share: float) -> np.ndarray:
    """N-grams that about ``share`` of the documents or more contain; only the order depends on them.

    A task hands on those that reach half the share among its own documents (3 at least)."""

    def run(batches):
        keys, counts, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        out = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            column = batch.column(0)
            for at in range(0, len(column), 2000):
                sets = [shingles(t, n) for t in column.slice(at, 2000).to_pylist()]
                seen += len(sets)
                new = _add_up(np.concatenate(sets)) if sets else (keys[:0], counts[:0])
                repeated = new[1] > 1
                keys, counts = _add_up(np.concatenate([keys, new[0][repeated]]),
                                       np.concatenate([counts, new[1][repeated]]))
        keep = counts >= max(3, share * seen / 2)
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(counts[keep])], schema=out)

    total = docs.count()
    part = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "gram long, n long")
    hot = part.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= max(4.0, share * total / 2))
    return np.sort(hot.select("gram").toArrow().column(0).to_numpy())


def most_apart(a: int, b: int, percent: int) -> int:
    """N-grams that linked sets of ``a`` and ``b`` n-grams differ in at most."""
    return (a + b) * (100 - percent) // (100 + percent)


def size_class(size: int, percent: int) -> tuple[int, int]:
    """Number and largest size of the class of ``size``.  Linked sets are of one class or of two that follow each other."""
    starts = _STARTS.setdefault(percent, [1])
    while starts[-1] <= size:
        largest = starts[-1]
        for _ in range(WIDTH):
            largest = 100 * largest // percent
        starts.append(largest + 1)
    at = bisect.bisect_right(starts, size)
    return at - 1, starts[at] - 1


@functools.lru_cache(64)
def _edges(count: int) -> np.ndarray:
    return np.array([-(-(k << 62) // count) for k in range(count)] + [1 << 62], np.int64)


def part_tokens(own: np.ndarray, hot: np.ndarray, percent: int) -> list[np.ndarray]:
    """Names of the parts by which a set meets linked ones of its size class, and of the next class."""
    size = len(own)
    cls, largest = size_class(size, percent)
    upto = 100 * size // percent  # the largest linked size
    following = size_class(largest + 1, percent)[1]
    wanted = [(cls, largest, most_apart(size, min(upto, largest), percent)),
              (cls + 1, following, most_apart(size, min(upto, following), percent) if upto > largest else 0)]
    if not any(apart for _, _, apart in wanted):  # only equal sets link
        return [own[:0], own[:0]]
    mixed = own.view(np.uint64) * _ODD[0]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD[1]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    rare = np.ones(size, bool)
    if len(hot):
        rare = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] != own
    rare = np.concatenate([np.zeros(1, np.int64), np.cumsum(rare)])
    out = []
    for number, top, apart in wanted:
        if not apart:
            out.append(own[:0])
            continue
        most = most_apart(top, top, percent)
        count = max(most + 1 + most // 8, top // 4)
        at = np.searchsorted(own, _edges(count))
        low, high = at[:-1], at[1:]
        names = sums[high] - sums[low] + np.arange(1, count + 1, dtype=np.uint64) * _ODD[2]
        names = (names ^ np.uint64(number)) * _ODD[1]
        names = (names ^ (names >> np.uint64(31))) * _ODD[0]
        names = (names ^ (names >> np.uint64(32))) * _ODD[1] >> np.uint64(64 - RANK_SHIFT)
        rank = RARE - np.minimum(rare[high] - rare[low], RARE) + (low == high)  # empty parts are last
        out.append(np.sort(rank << RANK_SHIFT | names.astype(np.int64))[:apart + 1])
    return out


def least_overlap(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def _points(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, hot: np.ndarray) -> DataFrame:
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = T.StructType([slim.schema["id"], *T.StructType.fromDDL(
        "n long, key binary, own int, parts array<long>, onward array<long>, sketch array<long>").fields])
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(ids, texts):
        sizes, keys, classes, names, sketches = [], [], [], ([], []), []
        for text in texts:
            own = shingles(text, n)
            sketches.append(sketch(own, percent))
            sizes.append(len(own))
            keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            classes.append(size_class(len(own), percent)[0])
            for all_, part in zip(names, part_tokens(own, shared.value, percent)):
                all_.append(part)
        lists = [list_array(np.concatenate(part) if part else np.zeros(0, np.int64), [len(x) for x in part], pa.int64())
                 for part in (*names, sketches)]
        return [ids, sizes, keys, classes, *lists]

    return materialize(map_rows(slim, run, schema), "jaccard-points")


BRIEF_SHIFT = 39  # of an order key of 63 bits, the first 24
EARLIER = 8
MOST_BITS = 1 << 14


def brief(prefix: np.ndarray) -> bytes:
    """The first three bytes of each order key: a narrow bound for regions of single n-grams."""
    return (prefix >> BRIEF_SHIFT).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unbrief(packed: bytes) -> np.ndarray:
    three = np.frombuffer(packed, np.uint8).reshape(-1, 3).astype(np.int32)
    return three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16


def sketch(own: np.ndarray, percent: int) -> np.ndarray:
    """Whether the n-grams of each remainder are odd in number, as bits of longs.  An n-gram that only one of two sets has turns one bit,
    so as many bits as differ, n-grams do at least.  There are four times as many bits as n-grams that linked sets of the size differ in."""
    apart = 2 * len(own) * (100 - percent) // (100 + percent)
    bits = min(MOST_BITS, max(64, 1 << max(0, 4 * apart - 1).bit_length()))
    odd = np.bincount(own & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def plausible(a, b, na, nb, percent: int):
    """False where the sketches ``a`` and ``b`` of sets of ``na`` and ``nb`` n-grams differ in more bits than linked sets may."""

    def fold(own, other):  # halves of a sketch put together are the sketch of half the bits
        half = F.size(own).cast("int") / 2
        halves = F.zip_with(F.slice(own, F.lit(1), half.cast("int")), F.slice(own, half.cast("int") + 1, half.cast("int")),
                            lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(own) > F.size(other), halves).otherwise(own)

    bits = F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0),
                       lambda all_, x: all_ + F.coalesce(x, F.lit(0)))
    return bits * (100 + percent) <= (na + nb) * (100 - percent)


def _plausible_pairs(pairs: DataFrame, home: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link, so that whole sets are fetched for them alone."""
    side = F.broadcast if pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS else lambda df: df
    of = lambda p: home.select(F.col("point").alias(p), F.col("n").alias(f"n{p}"), F.col("sketch").alias(f"s{p}"))
    right = of("b").join(side(pairs.select("b").distinct()), "b", "left_semi")
    both = of("a").join(side(pairs), "a").join(right, "b")
    return both.where(plausible(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"), percent)).select("a", "b")


def runs(table: pa.Table, keys: int):
    """Rows of ``table`` by equal first ``keys`` columns, as lists of tuples."""
    own: dict[tuple, list] = {}
    for row in zip(*[c.to_pylist() for c in table.columns]):
        own.setdefault(row[:keys], []).append(row)
    return own.values()


def pair_table(pairs: list[tuple]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})


def candidate_pairs(rows: list, percent: int) -> list[tuple]:
    """Pairs of one small region that the sizes cannot rule out, nor the first n-grams where rows have them.

    ``rows``: (token, size class, id, n, own class[, brief prefix]).  A pair is taken up in the size class of its larger
    point; with first n-grams, where the first common one is the region's.  Brief keys that are equal may belong to different n-grams, which
    only makes common n-grams seem more: the bound stays one, and a pair is passed over only if ``EARLIER`` common keys come before
    the region's.  (That many false ones in one pair are out of reach: one in a thousand pairs has one.)  So a pair may be
    taken up a few times."""
    token, cls = rows[0][:2]
    here = token >> BRIEF_SHIFT
    out = []
    points = sorted(((r[3], r[2], r[4], unbrief(r[5]) if len(r) > 5 else None) for r in rows), key=lambda p: p[:2])
    for j, (nb, b, cb, pb) in enumerate(points):
        if cb != cls:
            continue
        for na, a, _, pa_ in points[:j]:
            if 100 * na < percent * nb:
                continue
            if pa_ is None:
                out.append((a, b) if a < b else (b, a))
                continue
            common = pb[np.minimum(np.searchsorted(pb, pa_), len(pb) - 1)] == pa_
            if common[:np.searchsorted(pa_, here)].sum() >= EARLIER:
                continue
            upto = min(pa_[-1], pb[-1])  # below it both prefixes are complete
            la, lb = np.searchsorted(pa_, upto), np.searchsorted(pb, upto)
            apart = la + lb - 2 * common[:la].sum()
            if apart * (100 + percent) <= (na + nb) * (100 - percent):
                out.append((a, b) if a < b else (b, a))
    return out


def _whole_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``(id, grams)`` of the given ids, written once.  The ids are broadcast below a checked count."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    ids = ids.select(F.col("id").alias("_wanted"))
    slim = slim.join(F.broadcast(ids) if small else ids, F.col("id").eqNullSafe(F.col("_wanted")), "left_semi")
    schema = T.StructType([slim.schema["id"], T.StructField("key", T.BinaryType()),
                           T.StructField("grams", T.ArrayType(T.LongType()))])

    def run(keys, texts):
        sets = [shingles(t, n) for t in texts]
        cat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        return [keys, [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                list_array(cat, [len(s) for s in sets], pa.int64())]

    # Of an id that repeats with several texts, the point's key tells which text is meant.
    return materialize(map_rows(slim, run, schema), "jaccard-sets")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b: point keys) whose whole sets are similar enough.

    The sets are by far the widest rows.  Below a checked count the pairs are broadcast, so that only sets that some pair names leave
    their task; few sets on the side of b (pivots) are broadcast too, and then none does."""
    pairs = materialize(pairs, "jaccard-asked")
    few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    side = F.broadcast if few else lambda df: df
    left = sets.select(F.col("point").alias("a"), F.col("grams").alias("ga")).join(side(pairs), "a")
    right = sets.select(F.col("point").alias("b"), F.col("grams").alias("gb")).join(
        side(pairs.select("b").distinct()), "b", "left_semi")
    if few and (right.agg(F.sum(F.size("gb") + 8)).first()[0] or 0) <= BROADCAST_GRAMS:
        right = F.broadcast(right)
    both = left.join(right, "b")
    inter = F.size(F.array_intersect("ga", "gb"))
    return both.where(100 * inter >= percent * (F.size("ga") + F.size("gb") - inter)).select("a", "b")


def _cross(rows: list, percent: int) -> list[tuple]:
    """Links between outside points and other points of one block of a large region, one for each pair
    of labels.  ``rows``: (region, block, chunk, role, point, label, grams); role 0 is outside."""
    outer = [r for r in rows if r[3] == 0]
    inner = [r for r in rows if r[3] == 1]
    if not outer or not inner:
        return []
    n_a, n_b = (np.array([len(r[6]) for r in side]) for side in (outer, inner))
    all_a, all_b = (np.concatenate([np.array(r[6], np.int64) for r in side]) for side in (outer, inner))
    grams = np.intersect1d(all_a, all_b)
    inter = np.zeros((len(outer), len(inner)), np.int64)
    row_a, row_b = np.repeat(np.arange(len(outer)), n_a), np.repeat(np.arange(len(inner)), n_b)
    for at in range(0, len(grams), 4096):  # a slice of the common n-grams at a time
        part = grams[at:at + 4096]

        def dense(values, owner, height):
            col = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[col] == values
            m = np.zeros((height, len(part)), np.float32)
            m[owner[hit], col[hit]] = 1
            return m

        inter += (dense(all_a, row_a, len(outer)) @ dense(all_b, row_b, len(inner)).T).astype(np.int64)
    near = 100 * inter >= percent * (n_a[:, None] + n_b[None, :] - inter)
    found: dict[tuple, tuple] = {}
    for i, j in zip(*np.nonzero(near)):
        if outer[i][5] != inner[j][5]:
            found.setdefault((outer[i][5], inner[j][5]), (outer[i][4], inner[j][4]))
    return list(found.values())


def _labelled(members: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return members.withColumn("label", F.col("point"))
    labels = components(links).select(F.col("v").alias("point"), "label")
    return members.join(labels, "point", "left").withColumn("label", F.coalesce("label", "point"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS,
                       percent: int = PERCENT, hot_share: float = HOT_SHARE) -> DataFrame:
    """Per row: ``id_col``, ``n_shingles``, ``component_id``: the smallest id reachable by links of
    100 * intersection >= percent * union."""
    hot = hot_grams(docs, text_col, n, hot_share)
    points = _points(docs, id_col, text_col, n, percent, hot)
    # One point per distinct set; its name is the key of the set.  Only sets of several rows meet to be one.
    reps = materialize(points.where("n > 0").groupBy("key").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"),
        F.count(F.lit(1)).alias("copies")), "jaccard-reps")
    home = reps.select(F.col("key").alias("point"), "n", "sketch")
    copied = reps.where("copies > 1").select("key")
    copied = F.broadcast(copied) if copied.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else copied
    filled = points.where("size(parts) + size(onward) > 0").select("key", "n", "own", "parts", "onward")
    firsts = materialize(filled.join(copied, "key", "left_semi").groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("n", "own", "parts", "onward")]), "jaccard-firsts")
    filled = filled.join(copied, "key", "left_anti").unionByName(firsts)
    filled = filled.select(F.col("key").alias("point"), "n", "own", F.size("parts").alias("k"), F.concat("parts", "onward").alias("names"))
    # Parts of one point only make no region.  What is left is small beside the names: the
    # repeated ones are broadcast below a checked count, so that the names are not shuffled again.
    tokens = materialize(filled.select(F.explode("names").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("m")).where("m > 1").select("token"), "jaccard-tokens")
    small = tokens.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    entries = filled.select("point", "n", "own", "k", F.posexplode("names").alias("at", "token"))
    entries = materialize(entries.join(F.broadcast(tokens) if small else tokens, "token").select(
        "point", "n", "own", "token", (F.col("own") + (F.col("at") >= F.col("k")).cast("int")).alias("cls")), "jaccard-entries")
    # Points in a region by its size class: at least one of them must be at home in the class.
    regions = (entries.groupBy("token", "cls").agg(
        F.count(F.lit(1)).alias("m"), F.sum((F.col("own") == F.col("cls")).cast("int")).alias("home"),
        F.bit_xor(F.xxhash64("point")).alias("sig"), F.min(F.xxhash64("point")).alias("least"))
        .where("m > 1 AND home > 0"))
    regions = materialize(regions, "jaccard-regions")
    # Of regions of the same points one stands for all.
    small = materialize(regions.where(F.col("m") <= SMALL).groupBy("sig", "m", "cls").agg(
        F.min(F.struct("token", "least")).alias("r")).select("sig", "m", "cls", "r.*"), "jaccard-small")
    total, count = small.agg(F.sum("m"), F.count(F.lit(1))).first()
    small = small.select("token", "cls", "least")
    small = F.broadcast(small) if count <= BROADCAST_IDS else small
    deal = max(1, -(-int(total or 0) // ROWS_A_GROUP))  # regions go to groups of about so many rows
    # Regions of one first point go to one group, so that a pair of several of them is handed on once.
    rows = entries.join(small, ["token", "cls"]).select(
        F.pmod(F.xxhash64("least"), F.lit(deal)).alias("deal"), "token", "cls", "point", "n", "own")

    def search(dealt: pa.Table) -> pa.Table:
        out = []
        for region in runs(dealt.drop_columns("deal"), 2):
            out += candidate_pairs(region, percent)
        return pair_table(sorted(set(out)))

    pairs = materialize(rows.groupBy("deal").applyInArrow(search, "a binary, b binary").distinct(), "jaccard-pairs")
    pairs = materialize(_plausible_pairs(pairs, home, percent), "jaccard-plausible")

    # Large regions; tokens with the same points are one region.
    large = regions.where(F.col("m") > SMALL)
    chosen = large.groupBy("sig", "m").agg(F.min(F.struct("token", "cls")).alias("r")).select("r.*")
    chosen = materialize(chosen, "jaccard-chosen")
    chosen = F.broadcast(chosen) if chosen.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS else chosen
    members = materialize(entries.join(chosen, ["token", "cls"]).select(
        F.xxhash64("token", "cls").alias("region"), "point").distinct(), "jaccard-members")
    many = bool(members.limit(1).count())
    wanted = pairs.select(F.col("a").alias("point")).union(pairs.select("b")).union(members.select("point")).distinct()
    ids = materialize(reps.join(wanted, reps.key == wanted.point).select("point", F.col("rep").alias("id")), "jaccard-ids")
    sets = _whole_sets(docs, ids.select("id").distinct(), id_col, text_col, n)
    sets = materialize(sets.join(ids.select("point"), sets.key == F.col("point")).groupBy("point")
                       .agg(F.first("grams").alias("grams")), "jaccard-sets")
    links = materialize(_verify(pairs, sets, percent), "jaccard-links")
    if many:
        for turn in range(ROUNDS):
            now = materialize(_labelled(members, links), "jaccard-labels")
            # One point of each of the PIVOTS largest parts of a region, by a hash of the round.
            parts = now.groupBy("region", "label").agg(
                F.count(F.lit(1)).alias("m"), F.min(F.struct(F.xxhash64(F.lit(turn), "point"), "point")).alias("p"))
            rank = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("m"), "p"))
            pivots = materialize(parts.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).select(
                "region", F.col("p.point").alias("pivot"), F.col("label").alias("l")), "jaccard-pivots")
            new = (now.join(pivots, "region").where("label <> l AND point <> pivot")
                   .select(F.col("point").alias("a"), F.col("pivot").alias("b")).distinct())
            links = materialize(links.union(_verify(new, sets, percent)).distinct(), "jaccard-links")
        now = materialize(_labelled(members, links), "jaccard-labels")
        main = (now.groupBy("region", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("region")
                .agg(F.max(F.struct("m", "label")).alias("main"), F.sum("m").alias("size"))
                .where("main.m < size")
                .select("region", "size", F.col("main.label").alias("main"),
                        F.ceil((F.col("size") - F.col("main.m")) / BLOCK).cast("int").alias("blocks")))
        spread = now.join(materialize(main, "jaccard-main"), "region").withColumn(
            "outside", F.col("label") != F.col("main"))
        chunks = F.ceil(F.col("size") / CHUNK).cast("int")
        block_of = F.pmod(F.xxhash64(F.lit("b"), "point"), F.col("blocks")).cast("int")
        chunk_of = F.pmod(F.xxhash64(F.lit("c"), "point"), chunks).cast("int")
        numbers = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
        outer_rows = spread.where("outside").select("region", block_of.alias("block"), numbers(chunks).alias("chunk"),
                                                    F.lit(0).alias("role"), "point", "label")
        inner_rows = spread.select("region", numbers(F.col("blocks")).alias("block"), chunk_of.alias("chunk"),
                                   F.lit(1).alias("role"), "point", "label")
        blocks_in = outer_rows.union(inner_rows).join(sets, "point").select(
            "region", "block", "chunk", "role", "point", "label", "grams")

        def compare(block: pa.Table) -> pa.Table:
            return pair_table(_cross(list(zip(*[c.to_pylist() for c in block.columns])), percent))

        found = blocks_in.groupBy("region", "block", "chunk").applyInArrow(compare, "a binary, b binary")
        links = materialize(links.union(found), "jaccard-links")
    # Components over ids: points of one id are one node, points of null ids are nodes of their own.
    node = F.when(F.col("rep").isNull(), F.concat(F.lit("k"), F.hex("key"))).otherwise(
        F.concat(F.lit("i"), F.col("rep").cast("string")))
    names = reps.select(F.col("key").alias("point"), "rep", node.alias("node"))
    of = lambda side: names.select(F.col("point").alias(side), F.col("node").alias(f"n{side}"))
    by_id = links.join(of("a"), "a").join(of("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b")).where("a <> b")
    if by_id.limit(1).count():
        labels = components(by_id)
        named = names.join(labels, names.node == labels.v, "left").withColumn("label", F.coalesce("label", "node"))
        least = named.groupBy("label").agg(F.min("rep").alias("component"))
        final = named.join(least, "label").select(F.col("point").alias("key"), "component")
    else:
        final = names.select(F.col("point").alias("key"), F.col("rep").alias("component"))
    final = materialize(final, "jaccard-final")
    out = points.join(final, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))
