"""Hard negatives of anchors, exactly, by lists that the anchors of a cluster share.

For every anchor the ``positives`` best rows of its own label are found, and for each of these the ``negatives`` best rows
of other labels whose score lies between ``low`` and ``high`` per cent of the positive's.  A score is the inner product
of the vectors, whose components are first made ``floor(scale * x)``; ties go to the smaller id.

* Anchors are taken in groups of at most ``GROUP_BYTES`` of vectors, dealt by a hash of the row: that is what
  is broadcast, whatever the table's size.  A group's anchors are clustered (spherical k-means, fitted on at most
  ``SAMPLE`` of them); a cluster keeps its centre and the widest angle of a member.
* Every task reads its part of the table once, in chunks, and keeps the best rows so far of each anchor of the group.  For
  a chunk and a cluster the candidates are sorted once by their angular upper bound: a member within ``w`` of
  the centre has at most ``|x| cos(max(0, angle(x) - w))`` times its own length with a candidate x.  All members walk that
  one list in steps; a member leaves as soon as its bound falls below the worst score that it still could use,
  which certifies that nothing later in the list matters.
* The first search wants the anchor's label, so its lists hold one label; the second takes the others, with a
  window of scores for each positive, so that one walk serves all positives of a member.
* The tasks' few best rows for each anchor meet in a window over (anchor, positive).

Work is that of anchors against all rows in blocks, less what the bounds cut off; memory is bounded by the
group, and the rows that leave a task by the group too.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; rows with a
null id are candidates, come last among ties and are never anchors unless the caller's condition says so; rows that repeat an id
are rows of their own (an anchor is not its own positive, its copy may be); shorter vectors count as padded by
zeros; an empty table or one without anchors gives no rows.  Scores must stay below 2 ** 63.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatch.session import materialize

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
GROUP_BYTES = 32 << 20
SAMPLE, MEMBERS, TURNS = 8192, 256, 5  # anchors that fit the centres, anchors a cluster, rounds
CHUNK, STEP, TOGETHER = 8192, 256, 2048  # rows sorted at once, rows a step, members that walk at once
NO_ID = np.iinfo(np.int64).max
OUT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def quantised(rows: DataFrame, anchors: Column, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """Rows that take part: ``row, id, label, anchor, q`` (``array<long>``), written once."""
    vector = rows[vector_col]
    x = lambda v: v.cast("double")
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float("inf")))
    taken = rows.where(rows[label_col].isNotNull() & vector.isNotNull() & sound)
    return materialize(taken.select(
        F.monotonically_increasing_id().alias("row"), rows[id_col].cast("long").alias("id"),
        rows[label_col].cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.transform(vector, lambda v: F.floor(x(v) * scale)).alias("q")), "negatives-rows")


def matrix(q: pa.Array, dim: int, kind) -> np.ndarray:
    q = q.combine_chunks() if isinstance(q, pa.ChunkedArray) else q
    sizes = np.diff(q.offsets.to_numpy())
    out = np.zeros((len(q), dim), kind)
    out[np.arange(dim)[None, :] < sizes[:, None]] = q.flatten().to_numpy(zero_copy_only=False)
    return out


def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = vectors.astype(np.float64)
    size = np.sqrt((v * v).sum(1))
    return v / np.where(size > 0, size, 1)[:, None], size


def cluster(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit centres, and the centre of each vector."""
    unit, _ = units(vectors)
    fit = unit[np.random.default_rng(0).permutation(len(unit))[:SAMPLE]]
    centres = fit[:max(1, -(-len(unit) // MEMBERS))].copy()
    for _ in range(TURNS):
        near = (fit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, fit)
        held = np.sqrt((sums * sums).sum(1)) > 1e-9
        centres[held] = units(sums[held])[0]
    return centres, (unit @ centres.T).argmax(1)


class Group:
    """Anchors of one group, ordered by cluster, and the best rows found for them so far."""

    def __init__(self, rows, labels, vectors):
        centres, own = cluster(vectors)
        order = np.argsort(own, kind="stable")
        self.rows, self.vectors, self.labels = rows[order], vectors[order], [labels[i] for i in order]
        self.codes = {label: i for i, label in enumerate(dict.fromkeys(self.labels))}
        self.code = np.array([self.codes[label] for label in self.labels], np.int64)
        unit, self.size = units(self.vectors)
        used, self.starts = np.unique(own[order], return_index=True)
        self.centres = centres[used]
        self.ends = np.append(self.starts[1:], len(order))
        self.width = np.array([angles(unit[a:b] @ c).max() for a, b, c in zip(self.starts, self.ends, self.centres)])
        self.low = self.high = None  # the window of scores of each anchor and slot

    def window(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.low, self.high, self.k = low, high, k

    def begin(self) -> None:
        shape = (self.low.size, self.k)
        self.score = np.full(shape, -np.inf, self.vectors.dtype)
        self.id, self.row = np.full(shape, NO_ID), np.full(shape, NO_ID)
        self.least = self.low.copy()  # the worst score that an anchor's slot can still use

    def take(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Merge candidates into the best of their slots (numbers of anchor * slots + slot)."""
        touched = np.unique(slot)
        slot = np.concatenate([np.repeat(touched, self.k), slot])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids, rows = (np.concatenate([a[touched].ravel(), b]) for a, b in ((self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -score, slot))
        first = np.searchsorted(slot[order], touched)
        best = order[first[:, None] + np.arange(self.k)]
        self.score[touched], self.id[touched], self.row[touched] = score[best], ids[best], rows[best]
        flat = self.least.reshape(-1)
        flat[touched] = np.maximum(flat[touched], self.score[touched, -1])


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def walk(group: Group, members: np.ndarray, ids, rows, codes, vectors, bound, same: bool) -> None:
    """Members of one cluster walk one list, sorted by falling ``bound``."""
    slots = group.low.shape[1]
    for at in range(0, len(ids), STEP):
        wanted = group.least[members].min(1)
        members = members[group.size[members] * bound[at] * (1 + 1e-9) + 1e-3 >= wanted]
        if not len(members):
            return
        cut = slice(at, at + STEP)
        scores = group.vectors[members] @ vectors[cut].T
        if same:
            fits = rows[cut][None, :] != group.rows[members][:, None]
        else:
            fits = codes[cut][None, :] != group.code[members][:, None]
        for s in range(slots):
            ok = fits & (scores >= group.least[members, s][:, None]) & (scores <= group.high[members, s][:, None])
            some = np.nonzero(ok.any(1))[0]
            if not len(some):
                continue
            own = np.where(ok[some], scores[some], -np.inf)
            if own.shape[1] > group.k:  # only what reaches the k-th best of this step, with its ties
                kth = np.partition(own, -group.k, axis=1)[:, -group.k]
                own = np.where(own >= kth[:, None], own, -np.inf)
            r, c = np.nonzero(own > -np.inf)
            group.take(members[some[r]] * slots + s, own[r, c], ids[cut][c], rows[cut][c])


def search_chunk(group: Group, ids, rows, codes, vectors, same: bool) -> None:
    unit, size = units(vectors)
    for c, (a, b) in enumerate(zip(group.starts, group.ends)):
        bound = size * np.cos(np.maximum(0, angles(unit @ group.centres[c]) - group.width[c] - 1e-6))
        order = np.argsort(-bound, kind="stable")
        members = np.arange(a, b)
        # The first search has a list for each label of the cluster, the second one list for all.
        for code in np.unique(group.code[a:b]) if same else [None]:
            listed = order if code is None else order[codes[order] == code]
            own = members if code is None else members[group.code[a:b] == code]
            arrays = [x[listed] for x in (ids, rows, codes, vectors, bound)]
            for at in range(0, len(own), TOGETHER):
                walk(group, own[at:at + TOGETHER], *arrays, same)


def _search(items: DataFrame, group: Group, same: bool, name: str) -> DataFrame:
    """``anchor`` (number in the group), ``slot``, ``rank``, ``score``, ``id``: the group's best rows of all tasks."""
    spark = items.sparkSession
    shared = spark.sparkContext.broadcast(group)
    dim, kind, slots = group.vectors.shape[1], group.vectors.dtype, group.low.shape[1]
    schema = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64()),
                        ("row", pa.int64())])

    def run(batches):
        g = shared.value
        g.begin()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids = part.column(1).fill_null(NO_ID).to_numpy()
                codes = np.array([g.codes.get(x, -1) for x in part.column(2).to_pylist()], np.int64)
                search_chunk(g, ids, part.column(0).to_numpy(), codes, matrix(part.column(3), dim, kind), same)
        at, nth = np.nonzero(g.score > -np.inf)
        ids = g.id[at, nth]
        yield pa.RecordBatch.from_arrays([
            pa.array(at // slots), pa.array((at % slots).astype(np.int32)), pa.array(g.score[at, nth].astype(np.int64)),
            pa.array(ids, mask=ids == NO_ID), pa.array(g.row[at, nth])], schema=schema)

    # A task for each core, so that what leaves the tasks does not grow with their number as well.
    few = items.coalesce(max(1, spark.sparkContext.defaultParallelism))
    found = few.mapInArrow(run, "anchor long, slot int, score long, id long, row long")
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= group.k)
    return materialize(top.select("anchor", "slot", "rank", "score", "id"), name)


def mine_hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                        label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
                        low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """Per anchor, positive and rank: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    spark = rows.sparkSession
    taken = quantised(rows, anchors, id_col, vector_col, label_col, scale)
    facts = taken.agg(F.max(F.size("q")).alias("dim"), F.count_if("anchor").alias("anchors"),
                      F.max(F.array_max(F.transform("q", lambda v: F.abs(v)))).alias("largest")).first()
    if not facts["anchors"] or not facts["dim"]:
        return spark.createDataFrame([], OUT)
    kind = np.float64 if facts["dim"] * (facts["largest"] or 0) ** 2 < 1 << 53 else np.longdouble
    groups = -(-facts["anchors"] * facts["dim"] * np.dtype(kind).itemsize // GROUP_BYTES)
    items = taken.select("row", "id", "label", "q")
    out = None
    for turn in range(groups):
        own = taken.where(F.col("anchor") & (F.pmod(F.xxhash64("row"), F.lit(groups)) == turn))
        own = own.select("row", "id", "label", "q").toArrow()  # about GROUP_BYTES
        if not own.num_rows:
            continue
        vectors = matrix(own["q"], facts["dim"], kind)
        group = Group(own["row"].to_numpy(), own["label"].to_pylist(), vectors)
        group.window(np.full((len(vectors), 1), -np.inf, kind), np.full((len(vectors), 1), np.inf, kind), positives)
        found = _search(items, group, True, "negatives-positives")
        table = found.toArrow()  # the group's anchors times ``positives`` rows at most
        at = table["anchor"].to_numpy(), table["rank"].to_numpy() - 1
        wanted = np.full((len(vectors), positives), np.inf, kind)
        cap = np.full((len(vectors), positives), -np.inf, kind)
        scores = [int(s) for s in table["score"].to_pylist()]
        wanted[at] = [-(-low * s // 100) for s in scores]
        cap[at] = [high * s // 100 for s in scores]
        group.window(wanted, cap, negatives)
        worse = _search(items, group, False, "negatives-found")
        ids = dict(zip(own["row"].to_pylist(), own["id"].to_pylist()))
        names = spark.createDataFrame([(i, ids[int(r)]) for i, r in enumerate(group.rows)], "anchor long, anchor_id long")
        pairs = found.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"),
                             F.col("score").alias("positive_score"))
        part = worse.join(pairs, ["anchor", "slot"]).join(names, "anchor").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"))
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], OUT)
