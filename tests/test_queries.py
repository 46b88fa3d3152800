import pytest
from compare import same_rows
from pyspark.sql import functions as F

from vialens.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, name):
    same_rows(catalogue.QUERIES[name](spark, SF), SF, catalogue.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def test_greedy_places(spark):
    from vialens.plans import fixture

    rows = fixture.latest(fixture.fixes(spark, SF)).select("service", "event_id", "x", "y").collect()
    want = set()
    for service in {r["service"] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r["service"] == service), key=lambda r: r["event_id"]):
            if all((r["x"] - k["x"]) ** 2 + (r["y"] - k["y"]) ** 2 >= 1e6 for k in kept):
                kept.append(r)
        want |= {(service, r["event_id"]) for r in kept}
    got = {(r["service"], r["id"]) for r in catalogue.QUERIES["greedy_place_dedup"](spark, SF).collect()}
    assert got == want


def test_standing_by_movement_not_by_id(spark, monkeypatch):
    """A bus of low number that stops moving stands from then on; one of high number that drives does not."""
    from vialens.functions import geo
    from vialens.plans import fixture, spatial

    def fixes(spark, sf_dir):
        rows = [(k, "V001", 1800000000 + 20 * k, 150.0 * min(k, 40), 0.0) for k in range(120)]
        rows += [(1000 + k, "V035", 1800000000 + 20 * k, 150.0 * (k % 80), 1500.0) for k in range(120)]
        df = spark.createDataFrame(rows, "event_id long, vehicle string, t long, mx double, my double")
        return df.select("event_id", "vehicle", "t", (F.col("t") + 5).alias("seen_at"), geo.lat_of(F.col("my") + 1).alias("lat"), geo.lon_of(F.col("mx") + 1).alias("lon"), F.lit("474").alias("service"), F.lit(90.0).alias("heading"), F.lit("ida").alias("sentido"))

    monkeypatch.setattr(fixture, "fixes", fixes)
    cells = {(r["cx"], r["cy"]): r["buses"] for r in spatial.standing_cells(spark, SF).collect()}
    assert cells[(100, 0)] == 1 and all(cy == 0 and cx >= 75 for cx, cy in cells)
    assert [r["vehicle"] for r in catalogue.QUERIES["incoming_vehicles"](spark, SF).collect()] == ["V035"]
    last = fixture.latest_standing(fixes(spark, SF)).collect()
    assert {r["vehicle"]: r["standing"] for r in last} == {"V001": True, "V035": False}
