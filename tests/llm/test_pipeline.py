import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from swatch.llm.common import DOC_COLUMNS

SF = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark, odd, none):
    for name, stage in cp.STAGES:
        out = stage(spark, odd, SF)
        assert out.count() <= 10, name
        assert stage(spark, none, SF).count() == 0
        if name != "sentencepiece":
            assert out.columns == DOC_COLUMNS
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, odd, SF).collect()) == [1, 2, 3, 4, 5, 6, 7, 8]


def brute_kept(docs, n=5, percent=80):
    """Ids that stay: the smallest of each group linked by n-gram sets."""
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        sets[i] = {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if v == high else v for i, v in label.items()}
    return sorted(i for i, v in label.items() if i == v)


def test_near_duplicates_brute_force(spark):
    rng = random.Random(4)
    base = [f"a{k}" for k in range(200)]
    edited = [f"x{k}" if k in (20, 70, 120, 170) else w for k, w in enumerate(base)]  # 0.886 of 3 words, 0.815 of 5
    short = [f"b{k}" for k in range(50)]
    docs = [(0, " ".join(base)), (1, " ".join(edited)), (2, " ".join(short)), (3, " ".join(short[:25] + ["y"] + short[26:]))]
    for _ in range(8):
        text = [f"w{rng.randrange(300)}" for _ in range(rng.choice([30, 80, 150]))]
        for _ in range(6):
            own = list(text)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(90)}"
            docs.append((len(docs), " ".join(own)))
    d = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in docs],
                              "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in cp.near_duplicates(spark, d, SF).collect())
    assert got == brute_kept(docs) and 1 not in got and 3 not in got
    assert got != brute_kept(docs, 3, 90)


def test_near_duplicates_of_repeated_ids(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(30))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (4, text("e")), (4, text("e")),
            (None, text("f")), (None, text("g")), (5, text("g")), (6, text("h")), (6, text("h") + " end")]
    d = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows],
                              "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text[0]) for r in cp.near_duplicates(spark, d, SF).collect())
    assert got == [(0, "f"), (1, "a"), (2, "b"), (3, "c"), (3, "d"), (4, "e"), (5, "g"), (6, "h")]


def test_mask(spark):
    parts = "array<struct<start:long,kind_no:int,kind:string,end:long>>"
    d = spark.createDataFrame([("ab\U0001F600cdefgh", [(2, 0, "x", 4), (3, 0, "x", 5), (7, 0, "x", 8)])], f"text string, parts {parts}")
    assert d.select(cp.mask(F.col("text"), F.col("parts"))).first()[0] == "ab[SECRET]ef[SECRET]h"


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = cp.run(spark, SF)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 0.7 * docs.count() < len(ids) < docs.count()
