import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tickframe.plans import catalog


def test_range_join_makes_no_pairs(spark):
    orders = "/root/testdata/sf0.001/orders.parquet"
    plan = catalog.QUERIES["range_join"](spark, orders.rsplit("/", 1)[0])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and all("_at" in j and ">=" not in j for j in joins)


def test_followers_against_brute_force(spark):
    rng = random.Random(5)
    begin = datetime(1969, 12, 1)
    at = lambda: begin + timedelta(days=rng.randint(0, 60), microseconds=rng.choice([0, 0, 1, 43_200_000_000]))
    rows = [(rng.randint(0, 150), at()) for _ in range(300)] + [(1, begin), (1, begin), (2, begin), (None, begin), (3, None), (900, begin + timedelta(days=500))]
    rows += [(901, begin + timedelta(days=200)), (902, begin + timedelta(days=210)), (903, begin + timedelta(days=219, hours=23, minutes=59, seconds=59, microseconds=999_999))]
    want = {}
    for a, t in rows:
        n = sum(a is not None and b is not None and a != b and None not in (t, u) and t <= u < t + timedelta(days=10) for b, u in rows)
        if n:
            want[a] = want.get(a, 0) + n
    frame = spark.createDataFrame(rows, "k long, t timestamp_ntz")
    found = catalog.followers(frame, "k", "t", 10)
    assert {r.k: r.n for r in found.collect()} == want and 902 in want and 901 not in want and dict(found.dtypes)["n"] == "bigint"
    assert catalog.followers(frame.where(F.lit(False)), "k", "t", 10).collect() == []
