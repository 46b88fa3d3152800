from pyspark.sql import functions as F

from vialens.functions import basemap
from vialens.operators import basemap as build
from vialens.operators import views


def test_rings_of_one_feature(spark):
    """Holes live and die with the outer ring before them; slivers and rings of two points are left out."""
    rows = [("f", 0, -90.0, 4), ("f", 1, 100.0, 4), ("f", 2, -50.0, 5), ("f", 3, -10.0, 5), ("f", 4, 20.0, 4), ("f", 5, -50.0, 4), ("f", 6, 70.0, 2), ("g", 0, -80.0, 4)]
    rings = spark.createDataFrame(rows, "feature string, k int, area double, points int")
    assert [(r["feature"], r["k"]) for r in build.kept_rings(rings, "feature", "k", 40.0).orderBy("feature", "k").collect()] == [("f", 1), ("f", 2)]
    assert build.kept_rings(rings.limit(0), "feature", "k", 40.0).count() == 0


def test_labels(spark):
    rows = [(1, 0, "A", 0, 0.0, 0.0), (1, 0, "A", 1, 0.0, 50.0), (1, 0, "A", 2, -90.0, 50.0), (2, 0, "A", 0, 0.0, 0.0), (2, 0, "A", 1, 500.0, 0.0), (3, 0, "B", 0, 0.0, 0.0), (3, 0, "B", 1, 40.0, 0.0), (3, 0, "B", 2, 40.0, 40.0), (4, 0, "C", 0, 0.0, 0.0), (4, 0, "C", 1, 3.0, 4.0)]
    points = spark.createDataFrame(rows, "road int, tile int, name string, i int, x double, y double")
    got = {(r["name"], r["road"], r["x"], r["y"], r["angle"]) for r in build.road_labels(points, 30.0).collect()}
    assert got == {("A", 1, -45, 50, 0), ("B", 3, 20, 0, 0)}


def test_parts_left_out(spark):
    rows = [("water", 3, "lake", 12, "water"), ("water", 3, "fountain", 12, None), ("water", 2, "lake", 12, None), ("roads", 2, "minor_road", 12, None), ("roads", 2, "minor_road", 13, "road2"), ("landcover", 3, "beach", 15, "sand"), ("landuse", 3, "industrial", 15, None), (None, 3, "park", 15, None)]
    df = spark.createDataFrame(rows, "l string, g int, k string, z int, want string")
    assert df.where(~F.col("want").eqNullSafe(basemap.drawn_as(F.col("l"), F.col("g"), F.col("k"), F.col("z")))).count() == 0


def test_pending_sample(spark):
    cols = "vehicle string, service string, phase string, shape_id string, speed double, route_ix int, hypotheses int, beam_dist double, beam_progress double, beam_fixes int, accepted int, resets int"
    rows = [("b", "7", "pending", None, 3.0, 1, 2, 12.4, 40.0, 2, 5, 1), ("a", "7", "pending", None, 2.0, 1, 0, None, None, None, 1, 1), ("c", "7", "pending", None, 1.9, 1, 0, None, None, None, 1, 1), ("d", "7", "live", "s", 9.0, 1, 1, 1.0, 1.0, 1, 1, 1), ("e", "7", "pending", None, 9.0, None, 0, None, None, None, 1, 1)]
    states = spark.createDataFrame(rows, cols)
    assert [(r["vehicle"], r["best"]) for r in views.pending_sample(states, 20).collect()] == [("a", "no hypothesis"), ("b", "dist=12 prog=40 fixes=2")]
    assert views.pending_sample(states, 1).count() == 1


def test_lines_on_the_grid_in_one_pass(spark):
    """The one pass gives the lines and whole points that simplifying line by line does; long lines, ties, empty and null ones."""
    import random

    import numpy as np

    from vialens.functions import folds

    def kept(q, tol):
        keep, todo = {0, len(q) - 1}, [(0, len(q) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a > 1:
                d, rel = q[b] - q[a], q[a + 1 : b] - q[a]
                far = np.abs(rel[:, 0] * d[1] - rel[:, 1] * d[0]) / max(float(np.hypot(*d)), 1e-9)
                k = a + 1 + int(far.argmax())
                if far.max() > tol:
                    keep.add(k)
                    todo += [(a, k), (k, b)]
        return q[sorted(keep)]

    rng = random.Random(3)
    paths = [[(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(rng.choice([1, 2, 3, 3, 30]))] for _ in range(300)] + [[(0, 0), (4, 8), (8, 8), (12, 0)], [(5, 5), (5, 5), (5, 5)]]
    rows = [(k, p, rng.choice([64, 4096]), rng.choice([1.4, 2.0])) for k, p in enumerate(paths)] + [(-1, [], 64, 1.4), (-2, None, 64, 1.4)]
    df = spark.createDataFrame(rows, "k int, p array<struct<x:int,y:int>>, extent int, tol double")
    got = {r["k"]: r["g"] for r in df.select("k", folds.on_grid("p", F.lit(1024.0), "extent", "tol").alias("g")).collect()}
    for k, p, extent, tol in rows[:-2]:
        line = kept(np.asarray(p, float) * 1024.0 / extent, tol)
        whole = [tuple(int(np.sign(v) * np.floor(abs(v) + 0.5)) for v in xy) for xy in line]
        whole = [w for i, w in enumerate(whole) if i == 0 or w != whole[i - 1]]
        assert got[k]["line"] == line.ravel().tolist() and got[k]["flat"] == [v for w in whole for v in w]
    assert got[-1]["flat"] == [] and got[-2]["flat"] is None
