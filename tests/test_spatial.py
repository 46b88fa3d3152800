"""Nearest places by rings of cells, and runs of segments on loops."""

import math
import random

import pytest

from vialens.operators import spatial


@pytest.mark.parametrize("size", [1.0, 37.0, 5000.0])
def test_nearest_by_rings(spark, size):
    """Places in two far clusters, rows among them, between them and far outside; equally near ones; rows without a place."""
    rng = random.Random(int(size))
    places = [(f"p{k}", rng.gauss(0, 60), rng.gauss(0, 60)) for k in range(40)] + [(f"q{k}", 9000 + rng.gauss(0, 5), -4000 + rng.gauss(0, 5)) for k in range(10)] + [("r", 500.0, 0.0), ("s", 500.0, 0.0), ("none", None, 3.0)]
    rows = [(k, rng.gauss(0, 80), rng.gauss(0, 80)) for k in range(60)] + [(100 + k, rng.uniform(-20000, 20000), rng.uniform(-20000, 20000)) for k in range(15)] + [(200, 501.0, 1.0), (201, None, None)]
    got = spatial.nearest_by_rings(spark.createDataFrame(rows, "k int, x double, y double"), spark.createDataFrame(places, "p string, x double, y double"), "k", "p", size).collect()
    want = {k: min((math.hypot(x - px, y - py), p) for p, px, py in places if px is not None) for k, x, y in rows if x is not None}
    assert len(got) == len(want) and all((r["p"], pytest.approx(r["metres"])) == want[r["k"]][::-1] for r in got)


def test_nearest_of_nothing(spark):
    rows = spark.createDataFrame([(1, 2.0, 3.0)], "k int, x double, y double")
    none = spark.createDataFrame([], "p string, x double, y double")
    assert spatial.nearest_by_rings(rows, none, "k", "p", 10.0).count() == 0
    one = spark.createDataFrame([("a", 2.0, 3.0)], "p string, x double, y double")
    assert [tuple(r) for r in spatial.nearest_by_rings(rows, one, "k", "p", 10.0).collect()] == [(1, "a", 0.0)] and spatial.nearest_by_rings(rows.limit(0), one, "k", "p", 10.0).count() == 0


def plain_passes(px, py, line, radius, loop):
    runs, cum = [], [0.0]
    for a, b in zip(line, line[1:], strict=False):
        cum.append(cum[-1] + math.hypot(b[0] - a[0], b[1] - a[1]))
    for i, ((ax, ay), (bx, by)) in enumerate(zip(line, line[1:], strict=False)):
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)))
        d = math.hypot(px - ax - t * dx, py - ay - t * dy)
        if d <= radius:
            here = [i, i, d, cum[i] + t * (cum[i + 1] - cum[i])]
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
                if d < runs[-1][2]:
                    runs[-1][2:] = here[2:]
            else:
                runs.append(here)
    if loop and len(runs) > 1 and runs[0][0] == 0 and runs[-1][1] == len(line) - 2:
        last = runs.pop()
        runs[0][0] = last[0]
        if last[2] < runs[0][2]:
            runs[0][2:] = last[2:]
    return {(a, b, round(along, 6), round(d, 6)) for a, b, d, along in runs}


def test_passes_of_loops(spark):
    rng = random.Random(3)
    ring = [(1000 * math.cos(6.2831853 * k / 60), 1000 * math.sin(6.2831853 * k / 60)) for k in range(60)] + [(1000.0, 0.0)]
    eight = [(400 * math.sin(6.2831853 * 2 * k / 80), 900 * math.sin(6.2831853 * k / 80)) for k in range(80)] + [(0.0, 0.0)]
    lines = {"ring": ring, "eight": eight, "open": ring}
    pts = [(s, i, x, y, float(sum(math.dist(line[j], line[j + 1]) for j in range(i)))) for s, line in lines.items() for i, (x, y) in enumerate(line)]
    segs = spatial.segments(spark.createDataFrame(pts, "shape string, i int, x double, y double, cum double"), ["shape"])
    rows = [(k, 1000 * math.cos(a := rng.uniform(-0.3, 0.3)) + rng.gauss(0, 60), 1000 * math.sin(a) + rng.gauss(0, 60)) for k in range(40)] + [(50 + k, rng.uniform(-300, 300), rng.uniform(-300, 300)) for k in range(40)]
    loops = spark.createDataFrame([("ring", 59), ("eight", 79)], "shape string, last int")
    got = spatial.passes(spark.createDataFrame(rows, "k int, x double, y double"), segs, "k", "shape", 200.0, loops).collect()
    for k, x, y in rows:
        for s, line in lines.items():
            mine = {(r["first_seg"], r["last_seg"], round(r["along"], 6), round(r["dist"], 6)) for r in got if r["k"] == k and r["shape"] == s}
            assert mine == plain_passes(x, y, line, 200.0, s != "open")
    assert any(r["first_seg"] > r["last_seg"] for r in got)


def test_loop_passes_where_the_loop_closes(spark, tmp_path):
    """The first and the last segment of the loop are equally near this fix but for the last bit."""
    from compare import TABLES, same_rows

    from vialens.plans import catalogue

    for t in TABLES:
        if t != "events":
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("event_id between 57590 and 57610").write.parquet(str(tmp_path / "part"))
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "events.parquet")
    assert spark.read.parquet(str(tmp_path / "events.parquet")).where("event_id = 57600").count() == 1
    same_rows(catalogue.QUERIES["loop_passes"](spark, str(tmp_path)), str(tmp_path), catalogue.ORACLES["loop_passes"])


def test_places_at_one_point_and_no_broadcast(spark):
    """Places that share a point are one row, and none is broadcast: the plan of the search deals both sides by cell."""
    rows = spark.createDataFrame([(1, 0.0, 0.0), (2, 90.0, 3.0)], "k int, x double, y double")
    places = spark.range(3000).selectExpr("concat('p', id) as p", "cast(id % 3 * 50 as double) as x", "0d as y")
    spread = []
    kept, spatial._spread = spatial._spread, lambda at, size: spread.append(at.count()) or kept(at, size)
    try:
        got = {r["k"]: (r["p"], r["metres"]) for r in spatial.nearest_by_rings(rows, places, "k", "p", 100.0).collect()}
    finally:
        spatial._spread = kept
    assert got == {1: ("p0", 0.0), 2: (min(f"p{k}" for k in range(2, 3000, 3)), pytest.approx(math.hypot(10, 3)))}
    assert set(spread) == {3}


def test_cells_of_a_path(spark):
    """The cells of a route as the segments give them, for routes of one point, of repeated points and of long slants."""
    from pyspark.sql import functions as F

    from vialens.operators import evidence

    rng = random.Random(2)
    paths = {1: [(5.0, 5.0)], 2: [(5.0, 5.0), (5.0, 5.0)], 3: [(rng.uniform(-900, 900), rng.uniform(-900, 900)) for _ in range(9)]}
    pts = spark.createDataFrame([(r, i, x, y, 0.0) for r, p in paths.items() for i, (x, y) in enumerate(p)], "route int, i int, x double, y double, cum double")
    want = {tuple(r) for r in evidence.rasterised(spatial.segments(pts, ["route"]), 100.0).select("route", "cx", "cy").distinct().collect()}
    held = pts.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    got = [tuple(r) for r in held.select("route", F.explode(evidence.cells_of_path(F.col("p"), 100.0)).alias("c")).select("route", "c.cx", "c.cy").collect()]
    assert len(got) == len(want) and set(got) == want


def test_cells_are_found_once_a_route(spark):
    """No lambda of the plan walks a route's steps, and one pass over a batch gives all that is read of the cells."""
    from vialens.plans import catalogue

    plan = catalogue.QUERIES["grid_rasterise"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "transform(" not in plan


def test_cells_of_many_paths():
    """A batch with null and empty paths, points without a coordinate, and cells too far apart for one number."""
    import pyarrow as pa

    from vialens.operators import evidence

    rng = random.Random(4)
    some = lambda far: rng.choice([None, rng.uniform(-far, far), 0.0, far])
    for far in (900.0, 1e15):
        paths = [None, [], [None], [{"x": far, "y": 1.0}, {"x": far, "y": 1.0}]]
        paths += [[{"x": some(900.0) if far < 1e9 else far, "y": some(900.0) if far < 1e9 else -far} for _ in range(rng.randrange(7))] for _ in range(200)]
        paths += [[{"x": 0.0, "y": -far}] * 2] if far > 1e9 else []
        got = evidence._cells_of_paths(pa.array(paths, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), 100.0).to_pylist()
        for path, cells in zip(paths, got, strict=True):
            if path is None:
                assert cells is None
                continue
            want = set()
            for a, b in zip(path, path[1:]):
                if b is None or b["x"] is None:
                    continue
                a = a or {"x": None, "y": None}
                whole = None not in (a["x"], a["y"], b["y"])
                steps = math.floor(math.sqrt((b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2) / 100) + 1 if whole else 1
                cell = lambda c, k: None if a[c] is None or b[c] is None else math.floor((a[c] + (b[c] - a[c]) * k / steps) / 100)  # noqa: B023, E731
                want |= {(cell("x", k), cell("y", k)) for k in range(steps + 1)}
            found = [(c["cx"], c["cy"]) for c in cells]
            assert len(found) == len(want) and set(found) == want
