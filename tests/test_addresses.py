"""Answers kept by key: what counts, what is too old, what is too short to be asked."""

from pyspark.sql import functions as F

from vialens.functions import display
from vialens.operators import addresses


def test_keys(spark):
    df = spark.createDataFrame([("  Rua   das  Flores ", -22.90004, -43.4), (" ab ", -22.90006, -43.40004)], "t string, lat double, lon double")
    got = df.select(display.search_lookup(F.col("t")), display.reverse_lookup(F.col("lat"), F.col("lon"))).collect()
    assert [tuple(r) for r in got] == [("s:rua das flores", "r:-22.9000,-43.4000"), (None, "r:-22.9001,-43.4000")]


def test_looked_up(spark):
    answers = spark.createDataFrame([("k", 10, "old"), ("k", 20, "new"), ("gone", 5, "x"), ("edge", 6, "y")], "key string, at long, places string")
    requests = spark.createDataFrame([(1, "k"), (2, "k"), (3, "gone"), (4, "edge"), (5, None), (6, "never")], "id int, key string")
    got = {r["id"]: (r["places"], r["asked"]) for r in addresses.looked_up(requests, answers, 5 + addresses.TTL_S).collect()}
    assert got == {1: ("new", False), 2: ("new", False), 3: (None, True), 4: ("y", False), 5: (None, False), 6: (None, True)}
