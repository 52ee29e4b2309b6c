"""Running sums and row numbers against plain ones."""
import itertools
import random

from pyspark.sql import functions as F

from spreadlens.operators import metrics
from spreadlens.operators.prefix import numbered, running_sums


def test_running_sums_by_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", None]), i, rng.choice([0, 1, 5, None])) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = sorted(map(tuple, running_sums(df, [F.desc("i")], {"s": F.coalesce("v", F.lit(0))}, ("g",)).collect()), key=lambda r: r[1])
    want = []
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]), -r[1])), key=lambda r: r[0]):
        total = 0
        for g, i, v in own:
            total += v or 0
            want.append((g, i, v, total))
    assert got == sorted(want, key=lambda r: r[1])


def test_numbers_without_a_single_window(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    out = numbered(df, [F.desc("x")], "n", 1)
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    assert all(r.n == 1000 - r.x for r in out.collect())
    assert numbered(df.filter("false"), [F.desc("x")], "n").count() == 0


def test_rank_test_and_ecdf_have_no_single_window(spark):
    """Known ranks with ties, steps of each group, and no window over all rows in one task."""
    rows = [(v, g) for v, g in zip([1, 2, 2, 3, 5, 2, 4, 4, 6, 7], [0] * 5 + [1] * 5)]
    df = spark.createDataFrame(rows, "v long, g int")
    test = metrics.mann_whitney(df, "v", "g", 0, 1)
    steps = metrics.ecdf(df, "v", "g")
    # a plan ends in one row for the test, but no window's input is one partition
    for plan in (test, steps):
        assert "windowspecdefinition(v" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert test.first().u_statistic == sum((a > b) + (a == b) / 2 for a, i in rows for b, j in rows if i == 0 and j == 1)
    assert sorted(map(tuple, steps.collect())) == [(0, 1, .2), (0, 2, .6), (0, 3, .8), (0, 5, 1.), (1, 2, .2), (1, 4, .6), (1, 6, .8), (1, 7, 1.)]
