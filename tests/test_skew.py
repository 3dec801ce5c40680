"""Hot keys: joins that split them give the same rows, and no task gets a key's whole share."""

from pyspark.sql import functions as F

from helpers import rows
from swatch.operators import quality as qa
from swatch.operators import reports as rp
from swatch.operators.skew import grid_join, grid_of, salted_exists

N = 3000


def hot_rows(spark):
    """A third of the rows on one key, some null keys, the rest spread."""
    return spark.range(N).selectExpr("CASE WHEN id % 3 = 0 THEN 7L WHEN id % 50 = 1 THEN null ELSE id END AS k", "id AS v")


def largest_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def no_aqe(spark, run):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_salted_semi_and_anti_join(spark):
    df = hot_rows(spark)
    keys = spark.createDataFrame([(7,), (7,), (8,), (None,)], "k long")
    for exists, how in ((True, "left_semi"), (False, "left_anti")):
        assert rows(salted_exists(df, keys, "k", exists, 100)) == rows(df.join(keys, "k", how).select("k", "v"))
    split = no_aqe(spark, lambda: largest_task(salted_exists(df, keys, "k", True, 100)))
    plain = no_aqe(spark, lambda: largest_task(salted_exists(df, keys, "k", True)))
    assert plain >= N / 3 and split <= N / 6


def test_clashes_and_orphans_on_a_hot_key(spark):
    df = hot_rows(spark)
    target = spark.createDataFrame([(7,), (7,), (11,)], "k long")
    assert qa.key_clashes(df, target, "k", 100).count() == df.where("k IN (7, 11)").count()
    parents = spark.createDataFrame([(7, "x"), (9, "y")], "id int, v string")
    assert rows(qa.orphans(df, parents, "k", "id", 100)) == rows(df.where("k IS NOT NULL AND k NOT IN (7, 9)"))


def test_grid_join(spark):
    left, right = hot_rows(spark), spark.range(200).selectExpr("CASE WHEN id < 90 THEN 7L ELSE id END AS k", "id AS w")
    grid = grid_of(left, right, "k", 100, 10)
    assert rows(grid) == [(7, 11, 9)]
    got = grid_join(left, right, "k", grid)
    assert rows(got, "k", "v", "w") == rows(left.join(right, "k"), "k", "v", "w")
    split = no_aqe(spark, lambda: largest_task(grid_join(left, right, "k", grid)))
    assert split <= 90_000 / 4  # of 90,000 pairs of the hot key, over 8 tasks


def test_pages(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS id", "id AS v")
    pages = rp.Pages.of(df, files=8)
    assert len(pages.files) > 4 and pages.before[-1] == 1000
    for skip, limit in ((0, 10), (123, 7), (990, 50), (0, 1000), (1000, 5), (5000, 5), (pages.before[2], 3), (pages.before[3] - 1, 2)):
        assert [r.id for r in pages.page(skip, limit).collect()] == list(range(1000))[skip:skip + limit]
    deep = pages.page(900, 10)
    assert len(deep.inputFiles()) <= 2
    assert rp.Pages.of(df.limit(0)).page(0, 5).count() == 0
