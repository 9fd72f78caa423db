"""Even ranges against windows by group."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framelake.operators import analysis, even, select


def table(spark, seed, n, groups):
    rng = random.Random(seed)
    left = [(rng.choice(groups), rng.randrange(60), i) for i in range(n)]
    right = [(rng.choice(groups), rng.choice([None, *range(60)]) if rng.random() < 0.05 else rng.randrange(60), rng.choice("abc")) for _ in range(n // 4)]
    return spark.createDataFrame(left, "g string, t long, i long"), spark.createDataFrame([r for r in right if r[1] is not None], "g string, t long, v string")


@pytest.mark.parametrize("groups", [["a"], ["a"] * 20 + ["b", "c", None], list("abcdefgh")])
@pytest.mark.parametrize("forward", [False, True])
def test_asof_equals_the_window(spark, groups, forward):
    left, right = table(spark, len(groups), 400, groups)
    want = Counter(map(tuple, select.asof(left, right, ["g"], "t", ["v"], forward=forward).collect()))
    for per_task in (20, 7, 10_000):
        got = even.asof(left, right, ["g"], "t", ["v"], forward=forward, per_task=per_task)
        assert Counter(map(tuple, got.select("g", "t", "i", "v").collect())) == want
    empty = even.asof(left, right.limit(0), ["g"], "t", ["v"], forward=forward, per_task=50)
    assert empty.count() == 400 and empty.filter("v IS NOT NULL").count() == 0


def test_one_stream_is_dealt_to_all_tasks(spark):
    rows = spark.range(5000).select(F.lit("a").alias("g"), F.col("id").alias("t"))
    shares = [r["count"] for r in even.ranged(rows, ["g"], ["t"], 500).groupBy("_part").count().collect()]
    assert len(shares) == 10 and max(shares) < 1500
    same = rows.withColumn("t", F.lit(1).cast("long"))  # even all at one time
    shares = [r["count"] for r in even.ranged(same, ["g"], ["t"], 500).groupBy("_part").count().collect()]
    assert max(shares) < 1500


@pytest.mark.parametrize("groups", [["a"], ["a"] * 9 + ["b", None]])
def test_islands_equal_the_window(spark, groups):
    rng = random.Random(len(groups))
    rows = spark.createDataFrame([(rng.choice(groups), i, rng.choice([True, True, False, None])) for i in range(300)], "g string, t long, q boolean")
    want = Counter(map(tuple, analysis.islands(rows, ["g"], ["t"], F.col("q")).collect()))
    for per_task in (10, 64, 1000):
        assert Counter(map(tuple, even.islands(rows, ["g"], ["t"], F.col("q"), per_task).collect())) == want
    assert even.islands(rows.limit(0), ["g"], ["t"], F.col("q")).count() == 0
