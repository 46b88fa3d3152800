import json

import pytest
from pyspark.sql import functions as F

from vialens.functions import folds, times
from vialens.operators import bundles, documents, schedule
from vialens.sources import files, schedule_files
from vialens.streaming.keyed import KeyedTable

FILES = {
    "routes": "route_id,route_short_name,route_long_name,route_type,route_color,route_text_color\nr1,474,A - B,3,ff0000,zz\n",
    "trips": "trip_id,route_id,direction_id,shape_id,trip_headsign,service_id\nt1,r1,0,s1,B,U_REG\nt2,r1,0,s1,,U_REG\nt3,r9,0,s2,B,U_REG\n",
    "stops": "stop_id,stop_name,stop_lat,stop_lon\np0,Ponto Final: Praia,-22.9,-43.4\np1,BRS 1: Meio :: lado,-22.9,-43.39\np2,Fim,x,-43.38\n",
    "shapes": "shape_id,shape_pt_sequence,shape_pt_lat,shape_pt_lon,shape_dist_traveled\ns1,1,-22.9,-43.4,0\ns1,1,-22.9,-43.4,0\ns1,2,-22.9,-43.39,\ns1,3,-22.9,-43.38,\n",
    "stop_times": "trip_id,stop_sequence,stop_id,shape_dist_traveled,arrival_time\nt1,1,p0,0,25:00:00\nt1,2,p1,1024,25:03:00\nt1,3,p2,2048,25:06:00\nt2,1,p0,0,1:00:00\n",
    "frequencies": "trip_id,start_time,end_time,headway_secs\nt1,06:00:00,09:00:00,300\nt1,09:00:00,16:00:00,600\nt1,20:00:00,20:00:00,600\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nD_REG,0,0,0,0,0,0,1,20240301,20300228\nU_REG,1,1,1,1,1,0,0,20240301,20300228\nS_REG,0,0,0,0,0,1,0,20240301,20300228\n",
    "calendar_dates": "service_id,date,exception_type\nU_REG,20250421,2\nD_REG,20250421,1\nS_REG,20250607,2\nU_REG,20250607,1\nU_REG,20250609,2\nD_REG,20250615,1\n",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("feed")
    for n, t in FILES.items():
        (d / f"{n}.txt").write_text(t, encoding="utf-8")
    return schedule.build(schedule_files.read_feed(spark, str(d)))


def test_calendar(built):
    """A holiday on a Monday, a Saturday run as a working day, a Monday without service, a Sunday that is named though it runs anyway."""
    assert {r["date"]: r["svc"] for r in built["exceptions"].collect()} == {"20250421": 2, "20250607": 0, "20250609": None}
    assert [r["svc"] for r in built["weekdays"].orderBy("weekday").collect()] == [2, 0, 0, 0, 0, 0, 1]


def test_headways(built):
    assert sorted((r["svc"], r["from_hour"], r["to_hour"], r["minutes"]) for r in built["headways"].collect()) == [(0, 6, 9, 5), (0, 9, 16, 10)]


def test_rates_are_added_in_order(spark):
    """60 / rate is 12.5: rounded up if windows are added in order, down if the third comes before the second, as in the rows here."""
    ends = {1: 330, 2: 3260, 3: 2170}
    rows = spark.createDataFrame([("a", 0, k, 0, ends[k], 1200) for k in (1, 3, 2)], "line string, svc int, k long, start int, end int, headway int").coalesce(1)
    rate = schedule.hourly_rates(rows, ["k"])
    one, two, three = (3600.0 / 1200 * e / 3600.0 for e in ends.values())
    assert one + two + three == 4.8 < one + three + two
    assert [tuple(r) for r in rate.withColumn("minutes", schedule.headway_minutes(F.col("rate"))).collect()] == [("a", 0, 0, one + two + three, 13)]


def test_shapes(built):
    s = built["shapes"].collect()
    assert len(s) == 1 and s[0]["headsign"] == "B" and s[0]["length"] == pytest.approx(2048.6, abs=1) and not s[0]["circular"]
    assert s[0]["planned"] == pytest.approx(1024 / 180)
    assert [r["i"] for r in built["points"].orderBy("i").collect()] == [0, 1, 2]
    assert [(r["stop_id"], r["name"], r["note"]) for r in built["stops"].orderBy("stop_id").collect()] == [("p0", "Praia", "Ponto final"), ("p1", "Meio", "BRS 1 · lado")]
    assert built["routes"].first()["color"] == "#FF0000" and built["routes"].first()["text_color"] == ""
    assert built["trips"].count() == 2


def test_save_and_documents(spark, built, tmp_path):
    schedule.save({k: built[k] for k in ("routes", "shapes", "shape_stops", "points")}, str(tmp_path / "t"))
    again = schedule.load(spark, str(tmp_path / "t"), ["routes", "shapes", "shape_stops", "points"])
    doc = schedule.line_documents(again).first()
    assert doc["name"] == "474" and '"headsign":"B"' in doc["body"]
    path = json.loads(doc["body"])["shapes"][0]["path"]
    back = spark.createDataFrame([(path,)], "t string").select(folds.decode_polyline("t").alias("p")).first()["p"]
    assert back == pytest.approx([v for r in built["points"].orderBy("i").collect() for v in (r["lat"], r["lon"])], abs=5.1e-6)
    spark.range(1).withColumn("format_version", F.lit(1)).write.parquet(str(tmp_path / "old/routes"))
    with pytest.raises(ValueError):
        schedule.load(spark, str(tmp_path / "old"), ["routes"])


def test_static_documents(spark, built, tmp_path):
    """All documents of a small feed; a line that is renamed leaves no file behind."""
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["path"], "path string, digest string, size long")
    aka = spark.createDataFrame([("474", ["9"])], "short_name string, aka array<string>")
    docs = {r["path"]: json.loads(r["body"]) for r in bundles.static_documents(built, 11, aka).collect()}
    assert len(docs) == 6 + documents.cells(spark, 11).count()
    line = docs["lines/474.json"]
    assert {k: line[k] for k in ("line", "name", "type", "color", "text")} == {"line": "474", "name": "A - B", "type": 3, "color": "#FF0000", "text": ""}
    (way,) = line["dirs"]
    assert (way["shape"], way["dir"], way["circular"], way["headsign"], way["len"], way["planned"]) == ("s1", 0, False, "B", 2049, 5.7)
    assert way["freq"] == [[0, 6, 9, 5], [0, 9, 16, 10]] and way["stops"] == [["p0", -22.9, -43.4, "Praia", 0, "Ponto final"], ["p1", -22.9, -43.39, "Meio", 1024, "BRS 1 · lado"]]
    assert docs["lines.json"] == [["474", "A - B", 3, ["B"], ["9"], "#FF0000", ""]] and docs["freq.json"] == {"474": [[0, 6, 9, 5], [0, 9, 16, 10]]}
    assert docs["calendar.json"] == {"weekdays": [2, 0, 0, 0, 0, 0, 1], "exceptions": {"20250421": 2, "20250607": 0, "20250609": None}}
    assert docs["stops.json"] == [["p0", -22.9, -43.4, "Praia", "Ponto final"], ["p1", -22.9, -43.39, "Meio", "BRS 1 · lado"]] and docs["stop-lines.json"] == {"p0": ["474"], "p1": ["474"]}
    assert sorted(s[0] for p, d in docs.items() if p.startswith("cells/") for s in d) == ["p0", "p1"] and docs["cells/11/774/1156/stops.json"] == []
    root = f"file://{tmp_path}/public"
    assert files.write_documents(bundles.line_bundles(built), root, table, 0)["files"] == 1
    renamed = built | {"routes": built["routes"].withColumn("short_name", F.lit("475/A"))}
    assert files.write_documents(bundles.line_bundles(renamed), root, table, 1) | {"bytes": 0} == {"files": 1, "deleted": 1, "bytes": 0}
    assert sorted(p.name for p in (tmp_path / "public/lines").iterdir() if not p.name.endswith(".crc")) == ["475_A.json", "475_A.json.gz"]


def test_times(spark):
    rows = spark.createDataFrame([("27:42:38",), ("x",), ("1:2",)], "s string").select(times.schedule_seconds(F.col("s")).alias("v")).collect()
    assert [r["v"] for r in rows] == [99758, None, None]
    iso = ["2026-01-01T00:00:00Z", "2026-01-01T00:00:00.5-03:00", "2026-13-01T00:00:00Z", "", "2026-01-01 00:00:00"]
    got = spark.createDataFrame([(s,) for s in iso], "s string").select(times.parse_iso(F.col("s")).alias("v")).collect()
    assert [r["v"] for r in got] == [1767225600, 1767236400, None, None, 1767225600]


def test_polyline_and_simplify(spark):
    p = [38.5, -120.2, 40.7, -120.95, 43.252, -126.453]
    df = spark.createDataFrame([(p,)], "p array<double>").withColumn("t", folds.encode_polyline("p"))
    row = df.select("t", folds.decode_polyline("t").alias("back"), folds.simplified(F.expr("array(2d, 1d, 3d, 4d, 4d, 7.2d, 9d, 7d, 9d, 3d)"), F.lit(0.5)).alias("s")).first()
    assert row["t"] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@" and row["back"] == pytest.approx(p) and row["s"] == [2, 1, 4, 7.2, 9, 7, 9, 3]
