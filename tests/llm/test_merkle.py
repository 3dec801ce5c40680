"""The manifest against a plain tree: blocks of several sizes, nulls, ties, repeated rows, tampering."""

import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from swatch.llm import merkle

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(levels, at):
    for row in levels[:-1]:
        yield (row[at ^ 1] if at ^ 1 < len(row) else None), at % 2 == 1
        at //= 2


def plain(rows):
    """(id, leaf, subroot, root, proof, folded root) of (doc_id, source, lang, n_chars, text) rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {g: levels_of([leaf_of(r) for r in groups[g]]) for g in order}
    top = levels_of([trees[g][-1][0] for g in order])
    for q, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps = [*way(trees[g], i), *way(top, q)]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            f = leaf_of((*r[:3], r[3] + 1, r[4])) if bad else leaf_of(r)
            for s, left in steps:
                f = h(f) if s is None else h(s, f) if left else h(f, s)
            yield r[0], leaf_of(r), trees[g][-1][0], top[-1][0], h(*[s for s, _ in steps if s]), f


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_equals_a_plain_tree(spark, levels):
    rows = [(i if i % 11 else None, "s", [None, "", "a", "é"][i % 4 if i % 9 else 3], None if i % 5 == 0 else i,
             "x" * (50_000 if i == 13 else i) if i % 3 else None) for i in range(60)] * 2 + [(None,) * 5]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, "
                                 "n_chars long, text string, leaf string, pos int")
    got = merkle.manifest(docs, levels=levels).select(
        "doc_id", "leaf", "subroot", "root", merkle.proof(F.col("steps")), merkle.fold(F.col("leaf"), F.col("steps")))
    got = sorted((tuple(r) for r in got.collect()), key=key)
    assert all(r[5] == r[3] for r in got)
    assert [r[:5] for r in got] == sorted((r[:5] for r in plain(rows)), key=key)


def test_manifest_of_nothing_and_of_one(spark, none, odd):
    assert merkle.manifest(none).count() == 0
    one = merkle.manifest(odd.where("doc_id = 6")).first()
    assert one.leaf == one.subroot == one.root and one.steps == []


def test_appender_extends_witnesses_only_by_completed_siblings():
    tree = merkle.Appender(3)
    for d in "abcde":
        tree.append(d)
    ab, cd = merkle.node("a", "b"), merkle.node("c", "d")
    assert tree.siblings == [["b", cd], ["a", cd], ["d", ab], ["c", ab], []]
    root = tree.close()
    e = merkle.node(merkle.node("e"))
    assert tree.siblings[4] == [None, None, merkle.node(ab, cd)] and tree.siblings[0] == ["b", cd, e]
    assert root == merkle.node(merkle.node(ab, cd), e)


def test_query_finds_every_tampered_row(spark):
    import __spark_entry__ as entry

    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = entry.queries()["op12_merkle"](spark, SF).collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(plain(rows), key=key)
    assert {r.doc_id for r in got if not r.verified} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 0}
