"""Removing long byte strings that occur more than once, with a logarithmic family of suffix indexes.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else, in the same text or
another, is removed; strings never cross texts and are judged on the input.

* Sampled suffixes.  For each start of a ``LENGTH``-byte string, its anchor is the ``GRAM``-byte string in it
  with the smallest hash, the leftmost of equals.  Equal strings have equal anchors, so only suffixes at
  anchors are indexed.  Consecutive starts with one anchor form a block: (gram, hash of the block's bytes, text, first start, starts).
* A batch's suffix array is its table of blocks sorted by gram.  A new batch is merge-scanned against each existing
  level (a join on the sorted gram) and itself; grams met twice are noted.  Then levels of equal size
  merge, so that after n batches there are at most log2(n) + 1 levels, and a block is rewritten that often.
* Of the noted grams, blocks whose bytes occur twice are repeated as a whole.  The rest is compared
  start by start inside the group of its gram; groups of more than ``GROUP`` blocks are spread as one row per start
  and counted by Spark instead, so no group has to fit in a task.

Copies of a whole text collapse to one key first; with ``LENGTH`` bytes or more they vanish whole.  Null and empty texts,
and texts shorter than ``LENGTH`` bytes, lose nothing.  Strings are compared by 64-bit hashes beneath equal 64-bit gram
hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swatch.llm.common import map_rows
from swatch.session import materialize

LENGTH, GRAM = 400, 96
BATCHES = 4
GROUP = 8000
ROWS_A_GROUP = 4000
BROADCAST_ITEMS = 1_000_000

_LOW = (1 << 31) - 1
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int):
    """Powers of the hash's base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_STEP, _BACK)):
            line = np.full(max(n, 1 << 17), base, np.uint64)
            line[0] = 1
            _POWERS[i] = np.cumprod(line)
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of substrings of one text."""

    def __init__(self, data: bytes):
        n = len(data)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * up[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.down[begin])


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width, (1 << 64) - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    out = n - width + 1
    return np.minimum(behind[:out], ahead[width - 1:width - 1 + out])


def blocks_of(data: bytes, length: int, gram: int):
    """(gram hash, content hash, first start, number of starts) of the blocks of a text."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32))
    h = Hashes(data)
    at = np.arange(n - gram + 1)
    own = h.of(at, at + gram)
    # Of equal hashes the leftmost: the position fills the low 31 bits, and texts are shorter than 2^31.
    anchor = (_window_minima((own & ~np.uint64(_LOW)) | at.astype(np.uint64), length - gram + 1) & np.uint64(_LOW)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.append(first, len(anchor)))
    body = h.of(first, first + size - 1 + length)
    return own[anchor[first]].view(np.int64), body.view(np.int64), first.astype(np.int32), size.astype(np.int32)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))


def suffixes(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Blocks of all texts: ``key, gram, body, lo, size``; copies of a text still repeat."""
    schema = T.StructType.fromDDL("key binary, blocks array<struct<gram:long,body:long,lo:int,size:int>>")

    def run(keys, own):
        parts = [blocks_of(t.encode("utf-8"), length, gram) for t in own]
        columns = [np.concatenate(c) for c in zip(*parts)]
        inner = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["gram", "body", "lo", "size"])
        offsets = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts]))).astype(np.int32)
        return [keys, pa.ListArray.from_arrays(pa.array(offsets), inner)]

    found = map_rows(texts.select("key", "text").where(F.octet_length("text") >= length), run, schema)
    return found.select("key", F.explode("blocks").alias("b")).select("key", "b.*")


class SuffixIndex:
    """Levels of sorted suffix tables; ``add`` takes a batch of blocks (``suffixes``), once per text."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []  # (batches merged, table sorted by gram)
        self.noted: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        table = materialize(batch.dropDuplicates(["key", "lo"]).sortWithinPartitions("gram"), "suffix-level")
        grams = table.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        noted = grams.where("n > 1").select("gram")
        for _, level in self.levels:
            # Distinct on both sides: a gram that stands in very many texts is one row of the scan.
            noted = noted.union(grams.select("gram").join(level.select("gram").distinct(), "gram", "left_semi"))
        self.noted.append(materialize(noted.distinct(), "suffix-noted"))
        self.levels.append((1, table))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, one), (m, two) = self.levels.pop(), self.levels.pop()
            place = ["gram", "body", "key", "lo"]  # tells rows apart, so a frequent gram fills several ranges
            merged = one.union(two).repartitionByRange(*place).sortWithinPartitions(*place)
            self.levels.append((n + m, materialize(merged, "suffix-level")))

    def repeated(self) -> DataFrame:
        """All blocks whose gram was met more than once."""
        noted = self.noted[0]
        for more in self.noted[1:]:
            noted = noted.union(more)
        blocks = self.levels[0][1]
        for _, level in self.levels[1:]:
            blocks = blocks.union(level)
        return blocks.join(materialize(noted.distinct(), "suffix-noted"), "gram")


def _side(df: DataFrame, items: int) -> DataFrame:
    """Broadcast a table of a checked number of items, shuffle a larger one."""
    return F.broadcast(df) if items <= BROADCAST_ITEMS else df


def _runs(flags: np.ndarray):
    turn = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist()))


def _compare(table: pa.Table, length: int) -> pa.Table:
    """Repeated starts of the blocks of some grams: ``key, lo, hi`` (starts lo to hi - 1)."""
    rows = list(zip(*[c.to_pylist() for c in table.select(["gram", "key", "lo", "size", "content"]).columns]))
    hashes = []
    for *_, size, content in rows:
        at = np.arange(size)
        hashes.append(Hashes(content).of(at, at + length))
    gram = np.repeat(np.array([r[0] for r in rows], np.int64).view(np.uint64), [len(h) for h in hashes])
    _, inverse, n = np.unique(_mix(gram) ^ np.concatenate(hashes), return_inverse=True, return_counts=True)
    again, at, out = n[inverse] > 1, 0, []
    for (_, key, lo, size, _), h in zip(rows, hashes):
        out += [(key, lo + a, lo + b) for a, b in _runs(again[at:at + len(h)])]
        at += len(h)
    return pa.table({"key": pa.array([o[0] for o in out], pa.binary()), "lo": pa.array([o[1] for o in out], pa.int32()),
                     "hi": pa.array([o[2] for o in out], pa.int32())})


def repeated_starts(texts: DataFrame, blocks: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``key, lo, hi``: ranges of starts whose ``length`` bytes occur more than once."""
    blocks = materialize(blocks, "repeat-blocks")
    bodies = materialize(blocks.groupBy("gram", "body").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "lo", "size")).alias("one")), "repeat-bodies")
    whole = blocks.join(bodies.where("n > 1").select("gram", "body"), ["gram", "body"], "left_semi").select(
        "key", "lo", (F.col("lo") + F.col("size")).alias("hi"))
    # One block of each content meets the others of its gram; alone under its gram, it need not.
    open_ = bodies.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    wanted = materialize(bodies.join(materialize(open_, "repeat-grams"), "gram").select("gram", "kinds", "one.*", (F.col("n") > 1).alias("done")),
                         "repeat-wanted")
    per_text = materialize(wanted.groupBy("key").agg(F.collect_list(F.struct("gram", "kinds", "lo", "size", "done")).alias("asked")),
                           "repeat-asked")
    total = wanted.count()
    slim = texts.select("key", "text").join(_side(per_text, total), "key")
    schema = T.StructType.fromDDL("key binary, parts array<struct<gram:long,kinds:long,lo:int,size:int,done:boolean,content:binary>>")

    def cut(keys, own, asked):
        out = []
        for text, parts in zip(own, asked):
            data = text.encode("utf-8")
            out.append([{**p, "content": data[p["lo"]:p["lo"] + p["size"] - 1 + length]} for p in parts])
        return [keys, out]

    contents = (map_rows(slim, cut, schema).select("key", F.explode("parts").alias("p")).select("key", "p.*")
                .dropDuplicates(["key", "lo"]))
    contents = materialize(contents, "repeat-contents")
    common = contents.where(F.col("kinds") <= group)
    deal = max(1, -(-total // ROWS_A_GROUP))
    near = common.withColumn("deal", F.pmod(F.xxhash64("gram"), F.lit(deal))).groupBy("deal").applyInArrow(
        lambda t: _compare(t, length), "key binary, lo int, hi int")
    out = whole.union(near)
    hot = contents.where(F.col("kinds") > group)
    if hot.limit(1).count():
        line = T.StructType.fromDDL("gram long, key binary, starts array<struct<at:int,hash:long>>")

        def spread(grams_, keys, los, sizes, contents_):
            rows = []
            for lo, size, content in zip(los, sizes, contents_):
                at = np.arange(size)
                rows.append([{"at": lo + i, "hash": h} for i, h in enumerate(Hashes(content).of(at, at + length).view(np.int64).tolist())])
            return [grams_, keys, rows]

        starts = materialize(map_rows(hot.select("gram", "key", "lo", "size", "content"), spread, line)
                             .select("gram", "key", F.explode("starts").alias("s")).select("gram", "key", "s.*"), "repeat-starts")
        again = materialize(starts.groupBy("gram", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeat-again")
        out = out.union(starts.join(again, ["gram", "hash"], "left_semi").select(
            "key", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi")))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, batches: int = BATCHES, group: int = GROUP) -> DataFrame:
    """Per row: ``id_col``, ``n_bytes``, ``n_removed``, ``spans`` (removed byte ranges, maximal), ``kept`` (the
    remaining bytes, which may cut characters)."""
    texts = _texts(docs, id_col, text_col)
    found = materialize(suffixes(texts, length, gram).withColumn(
        "batch", F.pmod(F.xxhash64("key"), F.lit(batches)).cast("int")), "suffix-blocks")
    index = SuffixIndex()
    for b in range(batches):
        index.add(found.where(F.col("batch") == b).drop("batch"))
    starts = repeated_starts(texts, index.repeated(), length, group)
    ranges = starts.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    copies = (texts.select("key", F.octet_length("text").alias("n")).where(F.col("n") >= length)
              .groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    marked = ranges.join(copies, "key", "full").select("key", "ranges", F.col("copies").isNotNull().alias("whole"))

    def merge(keys, parts, wholes):
        """Maximal byte spans of the ranges of starts, so that little is left to join with the texts."""
        out = []
        for own, all_ in zip(parts, wholes):
            merged: list[dict] = []
            for lo, hi in [] if all_ else sorted((p["lo"], p["hi"] - 1 + length) for p in own):
                if merged and lo <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], hi)
                else:
                    merged.append({"begin": lo, "end": hi})
            out.append(merged)
        return [keys, out, wholes]

    removed = materialize(map_rows(marked, merge, T.StructType.fromDDL(
        "key binary, spans array<struct<begin:int,end:int>>, whole boolean")), "repeat-removed")
    items = removed.agg(F.sum(F.size("spans") + 1)).first()[0] or 0
    both = texts.join(_side(removed, items), "key", "left").select("id", "text", "spans", "whole")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T.StructType.fromDDL(
        "n_bytes long, n_removed long, spans array<struct<begin:int,end:int>>, kept binary").fields])

    def apply(ids, own, found_, wholes):
        sizes, gone, spans, kept = [], [], [], []
        for text, parts, all_ in zip(own, found_, wholes):
            data = text.encode("utf-8")
            merged = [(0, len(data))] if all_ else [(p["begin"], p["end"]) for p in parts or []]
            edge = [0, *[x for m in merged for x in m], len(data)]
            rest = b"".join(data[a:b] for a, b in zip(edge[::2], edge[1::2]))
            sizes.append(len(data)), gone.append(len(data) - len(rest)), kept.append(rest)
            spans.append([{"begin": a, "end": b} for a, b in merged])
        return [ids, sizes, gone, spans, kept]

    return map_rows(both, apply, schema)
