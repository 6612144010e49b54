import random

from pyspark.sql import functions as F

from emberfold.operators.ranking import in_ranges, with_place


def table(spark, n=3000):
    """A third of the rows is equal in group and order, another third has no group."""
    rng = random.Random(6)
    rows = []
    for i in range(n):
        group, value = [("hot", 5), (None, rng.randint(0, 9)), (f"g{rng.randint(0, 40)}", rng.randint(0, 3))][i % 3]
        rows.append((group, value, i))
    rows += [("same", 1, -1)] * 50
    return rows, spark.createDataFrame(rows, "grp string, value int, id long").repartition(5)


def test_places_equal_a_plain_sort(spark):
    rows, df = table(spark)
    for parts in (None, 7):
        got = with_place(df, ["grp"], [F.desc("value")], "at", parts).collect()
        assert sorted(str(tuple(r)[:3]) for r in got) == sorted(map(str, rows))
        for group in {r[0] for r in rows}:
            mine = sorted((r.at, r.value) for r in got if r.grp == group)
            assert [at for at, _ in mine] == list(range(1, len(mine) + 1))
            assert [v for _, v in mine] == sorted((v for _, v in mine), reverse=True)
    whole = with_place(df, [], ["value", "id"], parts=7).orderBy("place").collect()
    assert [(r.value, r.id) for r in whole] == sorted((v, i) for _, v, i in rows)
    assert [r.place for r in whole] == list(range(1, len(rows) + 1))
    assert with_place(df.limit(0), ["grp"], ["value"]).count() == 0


def test_equal_rows_spread_over_ranges(spark):
    _, df = table(spark)
    sizes = [r.n for r in in_ranges(df, ["grp", "value"], 8).groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * sum(sizes) / 8
