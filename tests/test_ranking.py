import random
import struct

import pytest
from pyspark.sql import functions as F

from fieldtrust.operators import ranking as r


def _bits(x: float) -> int:
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


def test_order_key_is_the_double(spark):
    rng = random.Random(1)
    xs = [0.0, 1.0, -1.0, 0.1, 1 - 2**-53, 2.0**-1022, 5e-324, 1.7e308, 4.0, 3.9999999999999996, 2.0**52 + 1]
    xs += [rng.uniform(-1e6, 1e6) for _ in range(500)] + [rng.random() for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", r.order_key(F.col("x")).alias("k"))
    assert all(row["k"] == _bits(row["x"]) for row in df.collect())


def test_order_key_infinite(spark):
    df = spark.createDataFrame([(float("inf"),), (1.7e308,)], "x double")
    inf, big = [row[0] for row in df.select(r.order_key(F.col("x"))).collect()]
    assert inf > big


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    rng = random.Random(2)
    # Half the values crowd just below one, as saturated confidences do.
    xs = {1 - i * 2**-53 for i in range(1, 60)} | {round(rng.random(), 3) for _ in range(80)} | {0.0, 1.0}
    rows = [(g, x, rng.randint(1, 5)) for g in ("a", "b", None) for x in xs]
    df = spark.createDataFrame(rows, "g string, x double, n bigint")
    got = r.running_sums(df, "x", {"n": "upto"}, ["g"], descending).collect()
    assert len(got) == len(rows)
    for row in got:
        want = sum(
            n for g, x, n in rows if g == row["g"] and (x >= row["x"] if descending else x <= row["x"])
        )
        assert row["upto"] == want


@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.95])
def test_value_at_fraction(spark, fraction):
    rng = random.Random(3)
    groups = {"a": 1, "b": 20, "c": 237, None: 13}
    data = {g: [round(rng.uniform(-50, 900), 1) for _ in range(n)] for g, n in groups.items()}
    df = spark.createDataFrame(
        [(g, x) for g, xs in data.items() for x in xs] + [("a", None), ("z", None)], "g string, x double"
    )
    got = {row["g"]: row["p95"] for row in r.value_at_fraction(df, "x", fraction, ["g"]).collect()}
    assert got == {g: sorted(xs)[int(len(xs) * fraction)] for g, xs in data.items()}


def test_twenty_values_give_the_largest(spark):
    df = spark.range(1, 21).select(F.col("id").cast("double").alias("x"))
    assert r.value_at_fraction(df, "x").first()[0] == 20.0


def test_value_at_fraction_empty(spark):
    assert r.value_at_fraction(spark.createDataFrame([], "x double"), "x").collect() == []


def test_weights(spark):
    df = spark.createDataFrame([(1.0, 90), (2.0, 5), (3.0, 5)], "x double, n bigint")
    assert r.value_at_fraction(df, "x", 0.95, weight="n").first()[0] == 3.0


def test_folds(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, label string")
    folds = r.stratified_folds(df, "label", "id").groupBy("label", "fold").count().collect()
    for label in "ab":
        sizes = [f["count"] for f in folds if f["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    other = r.stratified_folds(df, "label", "id", seed=7).exceptAll(r.stratified_folds(df, "label", "id"))
    assert other.count() > 0
