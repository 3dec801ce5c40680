"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and test items are normalised byte for byte: A-Z become a-z, every other ASCII byte that is no
digit or letter becomes a space, so a word keeps its offsets in the original.  A window is
``window`` consecutive words of an item (an item of fewer words, but not none, is one window).  All
windows go into one automaton; each text is scanned once, and every occurrence is mapped back to the
words, and the bytes, of the original.

The automaton is shared with all tasks, so its size is checked: items are dealt into blocks of at
most ``block_bytes`` of text, one automaton and one scan per block (one block for common test sets).
Null or wordless texts have no words and are never hit; null or wordless items have no window;
repeated items and windows are all credited; a repeated row gives a repeated result.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swatch.llm.common import held, map_rows

WINDOW = 10
BLOCK_BYTES = 32 << 20

# Word bytes map to themselves (A-Z to lower case), all others to a space.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32
              for b in range(256))


def fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8").translate(_FOLD)


class Automaton:
    """All windows of the items; ``scan`` gives the hit words of a text and the items they come from."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        import ahocorasick

        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            words = fold(text).split()
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(b" ".join(words[i:i + window]), set()).add(item)
        self.tree = ahocorasick.Automaton()
        for key, ids in owners.items():
            self.tree.add_word(f" {key.decode('latin-1')} ", (key.count(b" ") + 1, len(key) + 2, sorted(ids)))
        self.empty = not owners
        if owners:
            self.tree.make_automaton()

    def scan(self, text: str | None):
        """(number of words, byte spans of maximal runs of hit words, number of hit words, item ids)."""
        folded = fold(text)
        words = folded.split()
        if self.empty or not words:
            return len(words), [], 0, []
        line = f" {b' '.join(words).decode('latin-1')} "  # one character a byte
        found = list(self.tree.iter(line))
        if not found:
            return len(words), [], 0, []
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        first = np.searchsorted(spaces, [end - size + 1 for end, (_, size, _) in found])
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + [n for _, (n, _, _) in found], -1)
        hit = np.cumsum(edge)[:-1] > 0
        mask = np.zeros(len(folded) + 2, np.int8)  # where the words lie in the original
        mask[1:-1] = np.frombuffer(folded, np.uint8) != 32
        turn = np.diff(mask)
        begins, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        runs = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
        spans = [{"begin": int(begins[a]), "end": int(ends[b - 1])} for a, b in zip(runs[::2], runs[1::2])]
        ids = sorted({i for _, (_, _, own) in found for i in own})
        return len(words), spans, int(hit.sum()), ids


def _automaton(key: str, items, window: int) -> Automaton:
    return held(key, lambda: Automaton(items, window))  # a process holds one automaton at a time


OUTPUT = "n_words long, n_hit long, spans array<struct<begin:int,end:int>>, items array<string>"


def _scan(slim: DataFrame, items: list, window: int) -> DataFrame:
    shared, key = slim.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    schema = T.StructType([*slim.drop("text").schema.fields, *T.StructType.fromDDL(OUTPUT).fields])

    def run(*cols):
        tree = _automaton(key, shared.value, window)
        out = [tree.scan(t) for t in cols[-1]]
        n, spans, hit, ids = zip(*out) if out else ((), (), (), ())
        return [*cols[:-1], n, hit, spans, ids]

    return map_rows(slim, run, schema)


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: ``id_col``, ``n_words``, ``n_hit``, ``spans`` (byte spans of runs of hit words),
    ``items`` (ids, as strings, of the items with an occurring window, distinct, sorted as strings).

    One block of items: one pass in place, no shuffle.  More: one pass per block, of which only the
    documents with hits are shuffled, and a join by id and text digest unites them.  Overlapping
    spans of different blocks are counted once, by uniting their word ranges.
    """
    items = items.select(items[item_id].cast("string").alias("item"), items[item_text].alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    slim = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"))
    if blocks == 1:
        return _scan(slim, [tuple(r) for r in items.collect()], window).select(
            id_col, "n_words", "n_hit", "spans", "items")
    slim = slim.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)).select(id_col, "digest", "text")
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    hits = None
    for b in range(blocks):
        own = [tuple(r) for r in dealt.where(F.col("block") == b).select("item", "text").collect()]
        got = _scan(slim, own, window).where("n_hit > 0")
        hits = got if hits is None else hits.unionByName(got)
    united = (hits.groupBy(id_col, "digest")
              .agg(F.flatten(F.collect_list("spans")).alias("spans"),
                   F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
              .withColumnRenamed(id_col, "hit_id").withColumnRenamed("digest", "hit_digest"))
    schema = T.StructType([slim.schema[id_col], *T.StructType.fromDDL(OUTPUT).fields])

    def count(ids, texts, spans, items):
        n_words, n_hit, runs = [], [], []
        for text, own in zip(texts, spans):
            folded = fold(text)
            n_words.append(len(folded.split()))
            joined: list[dict] = []
            for s in sorted(own or [], key=lambda s: (s["begin"], s["end"])):
                # Spans end at words: runs with no word between them are one run.
                if joined and not folded[joined[-1]["end"]:s["begin"]].strip():
                    joined[-1]["end"] = max(joined[-1]["end"], s["end"])
                else:
                    joined.append(dict(s))
            runs.append(joined)
            n_hit.append(sum(len(folded[s["begin"]:s["end"]].split()) for s in joined))
        return [ids, n_words, n_hit, runs, [i or [] for i in items]]

    both = slim.join(united, slim[id_col].eqNullSafe(F.col("hit_id")) & (slim.digest == F.col("hit_digest")), "left")
    return map_rows(both.select(id_col, "text", "spans", "items"), count, schema)
