"""The publishing cycle, its tables, and vehicles that fall silent."""

import gzip
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from vialens.functions import geo, records
from vialens.operators import documents, processor
from vialens.plans import fixture, matching
from vialens.sources import files
from vialens.streaming import cycle, timed
from vialens.streaming.keyed import KeyedTable

SF = "/root/testdata/sf0.001"
COLUMNS = ["vehicle", "vendor", "t", "seen_at", "lat", "lon", "service", "heading", "dir"]


def test_keyed_table(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], "k string, v int")
    frame = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    rows = lambda: sorted(map(tuple, t.read().collect()), key=str)
    assert rows() == [] and t.merge(frame(("a", 1), ("b", 2), (None, 0)), 0) and rows() == [("a", 1), ("b", 2), (None, 0)]
    before = t.read()
    assert t.merge(frame(("a", 5), ("a", 4), ("c", 9), (None, 7)), 3, newest=["v"]) and rows() == [("a", 5), ("b", 2), ("c", 9), (None, 7)]
    assert before.count() == 3  # a reader of the version before is not disturbed
    assert not t.merge(frame(("a", 6)), 3) and rows()[0] == ("a", 5)
    assert t.merge(frame(("a", -1), ("z", -1)), 4, gone=F.col("v") < 0) and rows() == [("b", 2), ("c", 9), (None, 7)]
    assert len([f for f in os.listdir(tmp_path / "t") if f.startswith("v")]) == 2 and not [f for f in os.listdir(tmp_path / "t") if f.endswith(".part")]
    os.makedirs(tmp_path / "t/v9999999999-dead")  # a merge that died
    assert rows() == [("b", 2), ("c", 9), (None, 7)] and t.merge(frame(("b", 3)), 5) and ("b", 3) in rows()


def files_of(root):
    out = {}
    for d, _, names in os.walk(root):
        for n in names:
            if not n.endswith(".crc"):
                out[os.path.relpath(f"{d}/{n}", root)] = open(f"{d}/{n}", "rb").read()
    return out


def sink(spark, root, now):
    shapes, stops = matching.dims(spark)
    placed = stops.withColumn("lat", geo.lat_of(F.col("y"))).withColumn("lon", geo.lon_of(F.col("x")))
    lines = fixture.routes(spark).select(F.col("short_name").alias("line")).union(spark.createDataFrame([("88/A",)], "line string"))
    return cycle.Cycle(spark, f"file://{root}", shapes, placed, lines, zoom=11, version="v1", clock=lambda: now)


def test_two_batches_leave_what_one_leaves(spark, tmp_path):
    rows = matching.reports(spark, SF).where("vehicle in ('V000', 'V005', 'V010', 'V034')").select(*COLUMNS)
    net = matching.fleet_network(spark)
    cut, now = rows.agg(F.expr("percentile_disc(0.6) within group (order by seen_at)"), F.max("seen_at")).first()
    whole = processor.replay(rows, net, "states")
    one, two = sink(spark, tmp_path / "one", now), sink(spark, tmp_path / "two", now)
    one(whole, 0)
    two(processor.replay(rows.where(F.col("seen_at") <= cut), net, "states"), 0)
    two(whole, 1)
    got, want = files_of(tmp_path / "two/public"), files_of(tmp_path / "one/public")
    assert got == want and len(want) == 2 * (3 + 1 + 2 * documents.cells(spark, 11).count() + 3)
    assert json.loads(want["api/v1/lines/88_A.json"]) == [] and all(gzip.decompress(b) == want[f[:-3]] for f, b in want.items() if f.endswith(".gz"))
    fleet = json.loads(want["api/v1/fleet.json"])
    assert {v["id"] for v in fleet} == {r["vehicle"] for r in whole.collect()} and all(set(v) >= {"id", "line", "t", "lat", "lon", "ph", "brg", "spd", "cnf", "ven"} for v in fleet)
    index = json.loads(want["api/v1/index.json"])
    assert index["counts"]["tracked"] == len(fleet) and index["generated_at"] == now and sum(n for _, n in index["lines"]) == len(fleet)
    held = [a for f, b in want.items() if f.endswith("arrivals.json") for a in json.loads(b)]
    assert len(held) > 0 and all(len(a) == 10 and a[8] <= a[9] for a in held)
    two(whole, 1)  # handed over again
    two(whole, 2)
    assert two.last["files"] == 0 and files_of(tmp_path / "two/public") == want


def test_documents_no_longer_made_are_deleted(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["path"], "path string, digest string, size long")
    docs = spark.createDataFrame([("a/1.json", "[]"), ("a/2.json", "[1]")], "path string, body string")
    root = f"file://{tmp_path}/out"
    assert files.write_documents(docs, root, t, 0) == {"files": 2, "deleted": 0, "bytes": 5}
    assert files.write_documents(docs, root, t, 1) == {"files": 0, "deleted": 0, "bytes": 0}
    assert files.write_documents(docs.where("path = 'a/2.json'").withColumn("body", F.lit("[2,3]")), root, t, 2) == {"files": 1, "deleted": 1, "bytes": 5}
    assert {f for f in files_of(tmp_path / "out")} == {"a/2.json", "a/2.json.gz"}


def test_strings_are_escaped(spark):
    odd = 'a"b\\c\n\t\x01é'
    row = {"id": odd, "line": odd, "t": 5, "lat": -22.123456, "lon": -43.0, "bearing": None, "phase": "live", "dir": None, "shape_id": odd, "along": 12, "next_stop": None, "speed_kmh": 30, "conf": 0.95, "vendor": "sonda", "brt": True}
    df = spark.createDataFrame([row], "id string, line string, t long, lat double, lon double, bearing int, phase string, dir string, shape_id string, along int, next_stop string, speed_kmh int, conf double, vendor string, brt boolean")
    full, short = df.select(records.vehicle_record(True), records.vehicle_record(False)).first()
    assert json.loads(full) == {"id": odd, "line": odd, "t": 5, "lat": -22.12346, "lon": -43.0, "ph": "live", "brg": None, "shp": odd, "alo": 12, "spd": 30, "cnf": 0.95, "ven": "sonda", "brt": True}
    assert "line" not in json.loads(short)


def test_silent_vehicles_turn_stale_and_go(spark, tmp_path):
    """By the clock alone: one batch of fixes of 177 and of 297 s ago, and nothing after it."""
    for k, v in timed.STORE.items():
        spark.conf.set(k, v)
    now = int(time.time())
    fix = lambda vehicle, age: (vehicle, "sonda", now - age, now, -22.9, -43.35, "474", 90.0, "ida")
    schema = "vehicle string, vendor string, t long, seen_at long, lat double, lon double, service string, heading double, dir string"
    spark.createDataFrame([fix("A", 170), fix("B", 290), fix("C", 0), fix("C", 0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = timed.track(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), matching.fleet_network(spark))
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend((r["vehicle"], r["phase"], r["accepted"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        while time.time() < end and not {("A", "stale"), ("B", "gone")} <= {s[:2] for s in seen}:
            assert q.exception() is None
            time.sleep(0.5)
    finally:
        q.stop()
        for k in timed.STORE:
            spark.conf.unset(k)
    phases = {v: [p for w, p, _ in seen if w == v] for v in "ABC"}
    assert phases["A"][-1] == "stale" and phases["B"][-1] == "gone" and "gone" not in phases["A"]
    assert len(phases["C"]) == 1 and [n for w, _, n in seen if w == "C"] == [1]  # the repeated report counts once


@pytest.mark.parametrize("silent", [180, 181, 300, 301])
def test_aging(spark, silent):
    df = spark.createDataFrame([("a", 1000, "live")], "vehicle string, t long, phase string")
    got = [r["phase"] for r in cycle.aged(df, 1000 + silent).collect()]
    assert got == {180: ["live"], 181: ["stale"], 300: ["stale"], 301: []}[silent]
