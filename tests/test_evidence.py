"""Sampled minutes, ranks and strides, cells of segments, verdicts on codes and on places where buses sleep."""

import collections
import datetime
import json
import math
import random

from pyspark.sql import functions as F

from vialens.operators import evidence
from vialens.sources import landed


def test_named_minutes():
    now = int(datetime.datetime(2027, 3, 1, 6, 30, 20, tzinfo=datetime.UTC).timestamp())
    assert landed.sampled_hours(now, 3) == ["2027-03-01T06:25:00Z", "2027-03-01T05:25:00Z", "2027-03-01T04:25:00Z"]
    assert landed.sampled_nights(now, 2) == ["2027-03-01T06:00:00Z", "2027-02-28T06:00:00Z", "2027-02-28T07:00:00Z"]


def test_reads_named_minutes_only(spark, tmp_path):
    page = lambda k: json.dumps({"data": [{"id_veiculo": f"v{k}", "latitude": -22.9, "longitude": -43.4, "velocidade": 2.5, "datetime": "2027-03-01T06:00:00Z"}]})
    rows = [(f"2027-03-01T0{h}:00:00Z", p, page(h * 10 + p)) for h in range(6) for p in range(2)] + [("2027-03-01T03:00:00Z", 2, "{cut off")]
    root = str(tmp_path / "pages")
    df = spark.createDataFrame(rows, "minute string, page int, value string")
    landed.land(df.where("page = 0"), root)
    landed.land(df.where("page > 0"), root)
    minutes = ["2027-03-01T01:00:00Z", "2027-03-01T03:00:00Z", "2027-03-01T09:00:00Z"]
    fixes, failures = landed.read_minutes(spark, root, minutes)
    assert {r["vehicle"] for r in fixes.collect()} == {"v10", "v11", "v30", "v31"} and fixes.first()["speed"] == 2.5
    assert {tuple(r) for r in failures.collect()} == {("2027-03-01T09:00:00Z", "missing", 1), ("2027-03-01T03:00:00Z", "damaged", 1)}
    plan = landed.pages_of(spark, root, minutes)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2027-03-01T01:00:00Z" in plan.split("PartitionFilters: [")[1].split("]")[0]
    scanned = landed.pages_of(spark, root, minutes).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r["f"].split("minute=")[1][:13] for r in scanned} == {m[:13] for m in minutes[:2]}


def test_lists_named_minutes_only(spark, tmp_path):
    """The folders of other minutes are not listed: of 40 only the two that are asked for and there."""
    root = str(tmp_path / "pages")
    landed.land(spark.range(40).selectExpr("concat('2027-03-01T', lpad(id div 2, 2, '0'), if(id % 2 = 0, ':00:00Z', ':30:00Z')) as minute", "0 as page", "'{}' as value"), root)
    asked = ["2027-03-01T01:00:00Z", "2027-03-01T02:30:00Z", "2027-03-01T23:00:00Z", "2027-03-01T01:00:00Z"]
    assert len(landed.pages_of(spark, root, asked).inputFiles()) == 2
    assert landed.pages_of(spark, root, asked[2:3]).count() == 0 and landed.pages_of(spark, root, []).count() == 0


def test_a_history_makes_no_folder_a_minute(spark, tmp_path):
    """Fixes of 600 minutes lie in a few files; named minutes are read from them and from folders by minute, damaged pages told."""
    from vialens.plans.evidence import _MINUTE, land_fixes

    rows = spark.range(1200).selectExpr("concat('v', id) as vehicle", "1800000000 + 30 * id as t", "-22.9d as lat", "-43.4d as lon", "2.5d as speed")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        root = land_fixes(spark, rows, F.date_format(F.timestamp_seconds("t"), _MINUTE), F.lit(0))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    name = lambda k: landed._name(datetime.datetime.fromtimestamp(1800000000 + 60 * k, datetime.UTC))
    assert len(spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/{landed.HISTORY}").inputFiles()) <= 5
    asked = [name(3), name(599), name(700)]
    fixes, failures = landed.read_minutes(spark, root, asked)
    assert {r["vehicle"] for r in fixes.collect()} == {"v6", "v7", "v1198", "v1199"}
    assert [tuple(r) for r in failures.collect()] == [(name(700), "missing", 1)]
    landed.land(spark.createDataFrame([(name(700), 0, "{cut off"), (name(3), 9, '{"data": [{"id_veiculo": "late"}]}')], "minute string, page int, value string"), root)
    fixes, failures = landed.read_minutes(spark, root, asked)
    assert {r["vehicle"] for r in fixes.where("vehicle is not null").collect()} >= {"v6", "v7", "v1198", "v1199"} and landed.pages_of(spark, root, asked).count() == 4
    assert [tuple(r) for r in failures.collect()] == [(name(700), "damaged", 1)]
    assert landed.pages_of(spark, root, []).count() == 0


def test_all_pages(spark, tmp_path):
    """Pages of folders by minute and of a history, and of either alone."""
    page = lambda m: spark.createDataFrame([(f"2027-03-01T0{m}:00:00Z", m, str(m))], "minute string, page int, value string")
    got = lambda root: {(r["minute"], r["page"], r["value"]) for r in landed.all_pages(spark, root).collect()}
    row = lambda m: (f"2027-03-01T0{m}:00:00Z", m, str(m))
    both, folders = str(tmp_path / "both"), str(tmp_path / "folders")
    landed.land_history(page(1), both)
    assert got(both) == {row(1)}
    landed.land(page(2), both)
    landed.land(page(3), both)
    landed.land(page(4), folders)
    assert got(both) == {row(1), row(2), row(3)} and got(folders) == {row(4)}


def test_evidence_of_all_pages(spark):
    """Every fix under a code without a route counts, in whatever minute it was seen."""
    from compare import duck

    from vialens.plans import catalogue, fixture

    sf = "/root/testdata/sf0.01"
    _, rows = duck(sf, fixture.FX + " select service, count(*), count(distinct vehicle) from fx where service not in ('474', '7') group by service")
    assert {(r["service"], r["sampled"], r["buses"]) for r in catalogue.QUERIES["alias_evidence"](spark, sf).collect()} == set(rows) and sum(n for _, n, _ in rows) > 3000


def test_ranks_and_strides(spark):
    """A key of most rows lies over many tasks; ties, a null key, a key of one row."""
    rng = random.Random(4)
    rows = [("hot" if k % 4 else rng.choice(["a", "b", None]), rng.randrange(300), k) for k in range(4000)] + [("one", 1, 1)]
    df = spark.createDataFrame(rows, "service string, t long, id long").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = collections.defaultdict(list)
        for r in evidence.ranked(df, "service", ["t", "id"]).collect():
            got[r["service"]].append((r["rank"], r["t"], r["id"], r["n"]))
        sample = evidence.stride_sample(df, "service", ["t", "id"], 100).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for key in {r[0] for r in rows}:
        mine = sorted((t, i) for k, t, i in rows if k == key)
        assert sorted(got[key]) == [(n, t, i, len(mine)) for n, (t, i) in enumerate(mine)]
        assert sorted((r["t"], r["id"]) for r in sample if r["service"] == key) == mine[:: max(1, len(mine) // 100)]


def test_cells_that_segments_cross(spark):
    rng = random.Random(6)
    segs = [tuple(rng.uniform(-900, 900) for _ in range(4)) for _ in range(60)] + [(5.0, 5.0, 5.0, 5.0), (0.0, 0.0, 300.0, 0.0), (-10.0, -10.0, 10.0, 10.0)]
    df = spark.createDataFrame([(k, *s) for k, s in enumerate(segs)], "k int, ax double, ay double, bx double, by double")
    got = collections.defaultdict(set)
    for r in evidence.rasterised(df, 100.0).collect():
        got[r["k"]].add((r["cx"], r["cy"]))
    for k, (ax, ay, bx, by) in enumerate(segs):
        n = max(1, int(math.hypot(bx - ax, by - ay) // 100) + 1)
        assert got[k] == {(math.floor((ax + (bx - ax) * i / n) / 100), math.floor((ay + (by - ay) * i / n) / 100)) for i in range(n + 1)}


def test_shapes_near(spark):
    rng = random.Random(7)
    segs = [(f"s{k % 5}", *(rng.uniform(0, 1500) for _ in range(4))) for k in range(20)]
    points = [(k, rng.uniform(-100, 1600), rng.uniform(-100, 1600)) for k in range(300)]
    got = evidence.shapes_near(spark.createDataFrame(points, "k int, x double, y double"), spark.createDataFrame(segs, "shape string, ax double, ay double, bx double, by double"), ["k"], "shape").collect()

    def near(p, s):
        dx, dy = s[3] - s[1], s[4] - s[2]
        t = max(0, min(1, ((p[1] - s[1]) * dx + (p[2] - s[2]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[1] - s[1] - t * dx, p[2] - s[2] - t * dy) <= 60

    want = {(p[0], s[0]) for p in points for s in segs if near(p, s)}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20


def test_alias_verdicts(spark):
    fixes = [("10", f"b{k % 7}", "v1", "ida") for k in range(20)] + [("20", "b9", "v2", None)] * 12 + [("30", f"c{k}", f"v{k % 2}", None) for k in range(10)] + [("40", "d", "v1", "circular")] * 3
    rows = spark.createDataFrame(fixes, "service string, vehicle string, vendor string, dir string")
    covered = spark.createDataFrame([("10", "R1")] * 18 + [("10", "R2")] * 18 + [("10", "R3")] + [("20", "R3")] * 12 + [("30", "R1")] * 8, "service string, route string")
    reported = spark.createDataFrame([("10", "R1")] * 5 + [("30", "R1")] * 9, "service string, route string")
    got = {r["service"]: tuple(r)[1:] for r in evidence.alias_verdicts(rows, rows, covered, reported).collect()}
    assert got == {"10": (7, 20, "R1 25%", "R1 90%, R2 90%", "alias -> R1"), "20": (1, 12, "-", "R3 100%", "no line"), "30": (10, 10, "R1 90%", "R1 80%", "line without a route"), "40": (1, 3, "-", "-", "no line")}
    assert evidence.alias_verdicts(rows.limit(0), rows.limit(0), covered, reported).count() == 0


def test_garages(spark):
    """A yard in a diagonal of cells, a terminal, a yard of 40 beside an end, a small group, a sparse cell between two groups."""
    block = lambda tag, n, cx, cy: [(cx, cy, f"{tag}{k}") for k in range(n)]
    rows = block("a", 12, 0, 0) + block("b", 9, 1, 1) + block("t", 25, 100, 100) + block("g", 40, 300, 0) + block("s", 6, 0, 200) + block("x", 5, 1, 200) + block("y", 8, 2, 200) + block("a", 3, 2, 2)
    ends = spark.createDataFrame([("e1", 100 * 60.0, 100 * 60.0), ("e2", 300 * 60.0 + 30, 30.0), ("n", None, 1.0)], "end_id string, x double, y double")
    standing = spark.createDataFrame(rows, "cx long, cy long, vehicle string")
    got = {(r["x0"], r["y0"], r["x1"], r["y1"]): (r["cells"], r["buses"], r["verdict"]) for r in evidence.garage_groups(standing, ends).collect()}
    assert got == {(0, 0, 1, 1): (2, 21, "garage"), (100, 100, 100, 100): (1, 25, "terminal"), (300, 0, 300, 0): (1, 40, "garage"), (0, 200, 0, 200): (1, 6, "too few buses to tell"), (2, 200, 2, 200): (1, 8, "too few buses to tell")}
    boxes = evidence.garage_boxes(evidence.garage_groups(standing, ends)).orderBy("buses").collect()
    assert [r["buses"] for r in boxes] == [21, 40] and boxes[0]["lat0"] == round(-30 / 111320.0, 6) and boxes[0]["lat1"] == round(150 / 111320.0, 6)
    assert evidence.garage_groups(standing.limit(0), ends).count() == 0
    assert {r["verdict"] for r in evidence.garage_groups(standing, ends.limit(0)).collect()} == {"garage", "too few buses to tell"}


def test_slow_reports(spark):
    rows = [("a", -22.9, -43.4, None), ("a", -22.9, -43.4, 3.0), ("b", -22.9, -43.4, 3.1), ("c", None, -43.4, 0.0)]
    got = evidence.slow_cells(spark.createDataFrame(rows, "vehicle string, lat double, lon double, speed double")).collect()
    assert [r["vehicle"] for r in got] == ["a"]
