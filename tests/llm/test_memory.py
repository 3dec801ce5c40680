"""What the processes of tasks hold, and what the Jaccard join sends about."""

import random

import numpy as np
from pyspark.sql import functions as F

from swatch.llm import common, decontaminate, jaccard, languages, pieces


def test_one_memory_at_a_time(spark):
    def look(batches):
        jaccard.shingles("a b c d")
        first = list(common._HELD)
        decontaminate._automaton("built", [("i", "a b c")], 3)
        second = list(common._HELD)
        jaccard.shingles("a b c d")
        common.drop_held()
        yield from ()
        assert first == ["words"] and second == ["built"] and not common._HELD

    assert spark.range(1).mapInArrow(look, "x long").count() == 0


def test_languages_drop_other_memories(spark):
    docs = spark.createDataFrame([(i, "the cat sat", "en") for i in range(8)], "doc_id long, text string, lang string").coalesce(1)

    def fill(batches):
        for batch in batches:
            common.held("other", list)
            yield batch

    def left(batches):
        for batch in batches:
            assert not common._HELD
            yield batch

    model = languages.fit(docs)
    out = languages.identify(docs.mapInArrow(fill, docs.schema), model)
    assert out.mapInArrow(left, out.schema).count() == 8


def test_words_remembered_are_bounded(monkeypatch):
    monkeypatch.setattr(jaccard, "WORD_ENTRIES", 10)
    text = " ".join(f"w{i}" for i in range(200))
    assert len(jaccard.shingles(text)) == 198
    assert len(common.held("words", jaccard._Hashes)) <= 10
    common.drop_held()


def test_pieces_remember_a_word_once(monkeypatch):
    import public_tokenizers
    import sentencepiece

    monkeypatch.setattr(pieces, "MEMO_ENTRIES", 50)
    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        model = pieces.PieceModel(f.read())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for text in ("fox, fox fox. (fox)  fox", " ".join(f"w{i}x, {i}" for i in range(300)), "a  b   c, d ", "é1 _x x_y 日本, \n z"):
        assert model.encode(text, spans=False).tolist() == library.encode(text)
        if text.startswith("fox"):  # plain or before a comma, and without the mark
            assert "fox" in model.word and pieces.SPACE + "fox" not in model.part
    assert all(len(m) <= 50 for memo in (model.word, model.part) for m in (memo, memo.old))


def test_verified_sets_are_not_shuffled_for_few_pairs(spark, monkeypatch):
    rng = random.Random(3)
    sets = {bytes([i]): sorted(rng.sample(range(40), 30)) for i in range(12)}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    near = lambda a, b: len({*sets[a]} & {*sets[b]}) * 100 >= 65 * len({*sets[a]} | {*sets[b]})
    wanted = sorted(p for p in pairs if near(*p))
    assert 0 < len(wanted) < len(pairs)
    frames = spark.createDataFrame(pairs, "a binary, b binary"), spark.createDataFrame([*sets.items()], "point binary, grams array<long>")
    for most, grams, joins in ((500, 10_000, 0), (500, 0, 1), (0, 0, None)):
        monkeypatch.setattr(jaccard, "BROADCAST_PAIRS", most)
        monkeypatch.setattr(jaccard, "BROADCAST_GRAMS", grams)
        got = jaccard._verify(*frames, 65)
        assert sorted((bytes(r.a), bytes(r.b)) for r in got.select("a", "b").collect()) == wanted
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert joins is None or plan.count("SortMergeJoin") == joins


def test_regions_of_the_same_points_are_one(spark, monkeypatch):
    seen, whole = {}, jaccard.materialize

    def record(df, name="stage"):
        seen[name] = whole(df, name)
        return seen[name]

    monkeypatch.setattr(jaccard, "materialize", record)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words, "x"]), " ".join([*words, "y"]), "other text alone here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}
    small = seen["jaccard-small"]
    assert 0 < small.count() == small.select("sig", "m", "cls").distinct().count() < seen["jaccard-regions"].count()


def test_sketches_never_rule_out_a_link(spark):
    rng, rows, linked = np.random.default_rng(5), [], []
    for percent in (80, 90):
        for size in (1, 2, 10, 60, 150, 152, 700, 6000):
            for part in (0.0, 0.02, 0.05, 0.1, 0.11, 0.2, 0.5, 1.0):
                a = np.unique(rng.integers(0, 1 << 62, size))
                b = np.unique(np.concatenate([a[int(len(a) * part):], rng.integers(0, 1 << 62, int(rng.integers(0, 1 + int(size * part / 2))))]))
                if not len(b):
                    continue
                both = len(np.intersect1d(a, b))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
                rows.append((len(rows), percent, len(a), len(b), *[jaccard.sketch(x, percent).tolist() for x in (a, b)]))
    df = spark.createDataFrame(rows, "i int, p int, na long, nb long, a array<long>, b array<long>")
    got = {}
    for percent in (80, 90):
        ok = jaccard.plausible(*map(F.col, ("a", "b", "na", "nb")), percent).alias("ok")
        got |= {r.i: r.ok for r in df.where(F.col("p") == percent).select("i", ok).collect()}
    assert any(len(r[4]) != len(r[5]) for r, near in zip(rows, linked) if near)
    assert all(got[i] for i, near in enumerate(linked) if near) and sum(linked) < sum(got.values()) + 1 < len(got)


def test_unlike_pairs_fetch_no_sets(spark, monkeypatch):
    seen, whole = {}, jaccard.materialize

    def record(df, name="stage"):
        seen[name] = whole(df, name)
        return seen[name]

    monkeypatch.setattr(jaccard, "materialize", record)
    rng = random.Random(8)
    texts = [" ".join(f"x{d}y{i}" if rng.random() < 0.06 else f"w{d // 3}v{i}" for i in range(400)) for d in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {d: d for d in range(30)}
    assert seen["jaccard-pairs"].count() > 20 and seen["jaccard-sets"].count() == 0


def test_linked_sets_share_a_part_and_others_seldom_do():
    rng, none = np.random.default_rng(9), np.zeros(0, np.int64)
    for percent in (80, 90):
        for size in (5, 9, 10, 11, 12, 40, 150, 152, 700):
            for drop in (0.0, 0.03, 0.08, 0.12, 0.2):
                a = np.unique(rng.integers(0, 1 << 62, size))
                b = np.unique(np.concatenate([a[rng.random(len(a)) >= drop], rng.integers(0, 1 << 62, int(rng.integers(0, 2 + size * drop)))]))
                both = len(np.intersect1d(a, b))
                if both == len(a) == len(b) or 100 * both < percent * (len(a) + len(b) - both):
                    continue
                small, large = sorted((a, b), key=len)
                for hot in (none, a[::3], a):
                    own, onward = jaccard.part_tokens(small, hot, percent)
                    home = jaccard.part_tokens(large, hot, percent)[0]
                    assert len(np.intersect1d(np.concatenate([own, onward]), home))


def test_regions_do_not_grow_with_chance_words(spark, monkeypatch):
    seen, whole = {}, jaccard.materialize

    def record(df, name="stage"):
        seen[name] = whole(df, name)
        return seen[name]

    monkeypatch.setattr(jaccard, "materialize", record)
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(150)) for _ in range(300)]  # 1728 n-grams in all
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, hot_share=0.5).collect()}
    assert got == {d: d for d in range(300)}
    assert seen["jaccard-entries"].count() < 300
