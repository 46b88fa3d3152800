"""Evidence gathered from sampled minutes: codes that name no route, and places where buses sleep."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vialens import constants as C
from vialens.functions import geo
from vialens.operators import graph, spatial
from vialens.operators.stored import stored

#: A code is another name of a route that its buses cover in this percent of their fixes, if their shape ids name it most too.
COVERED_PCT = 85
#: A code of one vendor whose fixes have a direction less often than this is no line.
DIRECTED = 0.1
_M_PER_LON = C.EVIDENCE_M_PER_DEGREE * math.cos(math.radians(C.EVIDENCE_LAT))


def x_of(lon: Column) -> Column:
    return lon * _M_PER_LON


def y_of(lat: Column) -> Column:
    return lat * C.EVIDENCE_M_PER_DEGREE


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, in ``order``) and ``n`` of their ``key``, without a window over a key's rows.

    Rows are dealt by range and sorted, so that a key of very many rows lies in several tasks; each task's first place and count
    of a key give the ranks. The sorted rows are written, since their places must not change between the two reads.
    """
    at = F.monotonically_increasing_id()
    placed = stored(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("row_at", at), "ranked")
    placed = placed.withColumn("part", F.shiftright("row_at", 33))
    heads = placed.groupBy(key, "part").agg(F.min("row_at").alias("head"), F.count("*").alias("held"))
    of = Window.partitionBy(key)
    before = F.coalesce(F.sum("held").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select(F.col(key).alias("head_key"), F.col("part").alias("head_part"), (before - F.col("head")).alias("shift"), F.sum("held").over(of).alias("n"))
    met = placed.join(heads, (F.col("part") == F.col("head_part")) & F.col(key).eqNullSafe(F.col("head_key")))
    return met.select(*rows.columns, (F.col("row_at") + F.col("shift")).alias("rank"), "n")


def stride_sample(rows: DataFrame, key: str, order: list[str], most: int = C.SAMPLED) -> DataFrame:
    """Of each key every so many-th row in ``order``, so that about ``most`` remain: all of them up to twice as many."""
    every = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / most))
    return ranked(rows, key, order).where(F.col("rank") % every == 0).drop("rank", "n")


def crossed_cells(ax: Column, ay: Column, bx: Column, by: Column, size: float) -> Column:
    """The grid cells that a segment is seen in when it is walked in steps of under a cell: an array of structs cx, cy."""
    steps = F.greatest(F.lit(1).cast("long"), F.floor(geo.distance(ax, ay, bx, by) / size) + 1)
    cell = lambda a, b, k: F.floor((a + (b - a) * k / steps) / size)
    return F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), steps), lambda k: F.struct(cell(ax, bx, k).alias("cx"), cell(ay, by, k).alias("cy"))))


def _order(keys: list[np.ndarray]) -> np.ndarray:
    """``lexsort``, by one number for all keys where their ranges allow it."""
    one, most = np.zeros(len(keys[0]), np.int64), 1
    for c in reversed(keys) if len(one) else ():
        least = int(c.min())
        span = int(c.max()) - least + 1
        most *= span
        if most > 1 << 62:
            return np.lexsort(keys)
        one = one * span + (c.astype(np.int64) - least)
    return np.argsort(one)


def _cells_of_paths(points: pa.Array, size: float) -> pa.Array:
    """The cells of each of many paths, by numpy over all steps of all their segments."""
    count = pc.fill_null(pc.list_value_length(points), 0).to_numpy()
    flat = points.flatten()
    at = [pc.struct_field(flat, n) for n in ("x", "y")]
    no = [c.is_null().to_numpy(zero_copy_only=False) for c in at]
    xy = [pc.fill_null(c, 0.0).to_numpy() for c in at]
    path = np.repeat(np.arange(len(points)), count)
    a = np.flatnonzero((path[1:] == path[:-1]) & ~no[0][1:])  # segments by their first point
    across, void = [c[a + 1] - c[a] for c in xy], [n[a] | n[a + 1] for n in no]
    steps = np.where(void[0] | void[1], 0, np.floor(np.sqrt(across[0] * across[0] + across[1] * across[1]) / size)).astype(np.int64) + 1
    seg = np.repeat(np.arange(len(a)), steps + 1)
    k = np.arange(len(seg)) - np.repeat(np.cumsum(steps + 1) - steps - 1, steps + 1)
    cell = [np.where(n[seg], 0, np.floor((c[a][seg] + d[seg] * k / steps[seg]) / size)).astype(np.int64) for c, d, n in zip(xy, across, void, strict=True)]
    keys = [void[1][seg], cell[1], void[0][seg], cell[0], path[a][seg]]
    order = _order(keys)
    keys = [c[order] for c in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in keys])
    no_y, cy, no_x, cx, path = (c[new] for c in keys)
    structs = pa.StructArray.from_arrays([pa.array(cx, mask=no_x), pa.array(cy, mask=no_y)], ["cx", "cy"])
    offsets = np.searchsorted(path, np.arange(len(points) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), structs, mask=points.is_null())


def cells_of_path(points: Column, size: float) -> Column:
    """The grid cells that a path crosses, each once: an array of structs cx, cy from an array of structs x, y in order. A point
    without x ends no segment. The paths of an Arrow batch are walked together: lambdas in the plan take each step by itself."""

    @F.arrow_udf("array<struct<cx: bigint, cy: bigint>>")
    def cells(points: pa.Array) -> pa.Array:
        return _cells_of_paths(points, size)

    return cells(points)


def rasterised(segs: DataFrame, size: float) -> DataFrame:
    """``segs`` (``ax, ay, bx, by``), a row for each cell (``cx, cy``) that a segment crosses."""
    cells = crossed_cells(*map(F.col, ("ax", "ay", "bx", "by")), size)
    return segs.withColumn("__c", F.explode(cells)).select("*", "__c.cx", "__c.cy").drop("__c")


def shapes_near(rows: DataFrame, segs: DataFrame, key: list[str], shape: str, radius: float = C.COVER_M, size: float = C.COVER_CELL_M) -> DataFrame:
    """``key, shape``, each pair once: the shapes with a segment within ``radius`` of a row (``x, y``).

    Segments are rasterised once and spread over the cells around theirs, so that a row looks into its own cell only.
    """
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    grid = rasterised(segs.select(shape, "ax", "ay", "bx", "by"), size).withColumn("d", F.explode(around))
    grid = grid.select(shape, "ax", "ay", "bx", "by", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy")).distinct()
    at = rows.select(*key, "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    ax, ay, bx, by = map(F.col, ("ax", "ay", "bx", "by"))
    t = geo.on_segment(F.col("x"), F.col("y"), ax, ay, bx, by)
    met = at.join(grid, ["cx", "cy"]).where(geo.distance(F.col("x"), F.col("y"), ax + t * (bx - ax), ay + t * (by - ay)) <= radius)
    return met.select(*key, shape).distinct()


def _leading(rows: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """``service``, the two routes with the most rows of each service as text, and the first one with its percent of ``of`` (``service, n``)."""
    counts = rows.groupBy("service", "route").agg(F.count("*").alias("c")).join(of, "service")
    pct = F.bround(100.0 * F.col("c") / F.col("n")).cast("long")
    two = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("o"), "route", pct.alias("pct")))), 1, 2)
    best = counts.groupBy("service").agg(two.alias("b"))
    text = F.array_join(F.transform("b", lambda r: F.concat(r["route"], F.lit(" "), r["pct"], F.lit("%"))), ", ")
    return best.select("service", text.alias(name), F.col("b")[0]["route"].alias(f"{name}_route"), F.col("b")[0]["pct"].alias(f"{name}_pct"))


def alias_verdicts(rows: DataFrame, sample: DataFrame, covered: DataFrame, reported: DataFrame) -> DataFrame:
    """``service, buses, sampled, reported, covered, verdict`` of each service in ``rows`` (``service, vehicle, vendor, dir``).

    ``reported`` (``service, route``) has a row for each fix and route that its shape id names, ``covered`` one for each fix of
    ``sample`` and route near it. Both are shown as the two leading routes with their percent of all fixes and of the sample.
    """
    directed = F.count_if(F.col("dir").isin("ida", "volta"))
    all_ = rows.groupBy("service").agg(F.count("*").alias("n"), F.countDistinct("vehicle").alias("buses"), F.countDistinct("vendor").alias("vendors"), directed.alias("dirs"))
    taken = sample.groupBy("service").agg(F.count("*").alias("n"))
    met = all_.join(_leading(reported, all_.select("service", "n"), "reported"), "service", "left").join(_leading(covered, taken, "covered"), "service", "left").join(taken.withColumnRenamed("n", "sampled"), "service")
    alias = (F.col("covered_route") == F.col("reported_route")) & (F.col("covered_pct") >= COVERED_PCT)
    verdict = F.when(alias, F.concat(F.lit("alias -> "), "covered_route")).when((F.col("vendors") == 1) & (F.col("dirs") < DIRECTED * F.col("n")), "no line").otherwise("line without a route")
    return met.select("service", "buses", "sampled", F.coalesce("reported", F.lit("-")).alias("reported"), F.coalesce("covered", F.lit("-")).alias("covered"), verdict.alias("verdict"))


def slow_cells(fixes: DataFrame) -> DataFrame:
    """``cx, cy, vehicle``, each once: where vehicles of ``fixes`` (``vehicle, lat, lon, speed``) stand by what they report; no speed is none."""
    slow = fixes.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.coalesce("speed", F.lit(0.0)) <= C.SLOW_KMH))
    return slow.select(F.floor(x_of(F.col("lon")) / C.NIGHT_CELL_M).alias("cx"), F.floor(y_of(F.col("lat")) / C.NIGHT_CELL_M).alias("cy"), "vehicle").distinct()


def dense_cells(standing: DataFrame) -> DataFrame:
    """``cx, cy, buses`` of the cells with six different buses or more."""
    return standing.groupBy("cx", "cy").agg(F.count("*").alias("buses")).where(F.col("buses") >= C.DENSE_BUSES)


def garage_groups(standing: DataFrame, ends: DataFrame) -> DataFrame:
    """Groups of touching dense cells: ``root, cells, buses, x0, y0, x1, y1`` (in cells), ``end_m`` and ``verdict``.

    ``ends`` (``end_id, x, y``) are the first and last points of all shapes. A garage has 40 buses, or 20 and no end within 150 m
    of its middle; a smaller group near an end is a terminal, and of any other one there are too few buses to tell.
    """
    node = (F.col("cx") + 10_000_000) * 100_000_000 + F.col("cy") + 10_000_000
    dense = stored(dense_cells(standing).withColumn("node", node), "dense")
    steps = F.array(*(F.lit(i * 100_000_000 + j) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    edges = dense.select("node", F.explode(steps).alias("d")).select(F.col("node").alias("a"), (F.col("node") + F.col("d")).alias("node")).join(dense.select("node"), "node").select("a", F.col("node").alias("b"))
    named = standing.join(dense.select("cx", "cy", "node"), ["cx", "cy"]).join(graph.components(dense.select("node"), edges), "node")
    groups = named.groupBy("root").agg(F.countDistinct("node").alias("cells"), F.countDistinct("vehicle").alias("buses"), F.min("cx").alias("x0"), F.min("cy").alias("y0"), F.max("cx").alias("x1"), F.max("cy").alias("y1"))
    groups = stored(groups, "groups")
    half = C.NIGHT_CELL_M / 2
    middle = groups.select("root", ((F.col("x0") + F.col("x1") + 1) * half).alias("x"), ((F.col("y0") + F.col("y1") + 1) * half).alias("y"))
    away = spatial.nearest_by_rings(middle, ends, "root", "end_id", 500.0).select("root", F.col("metres").alias("end_m"))
    garage = (F.col("buses") >= C.GARAGE_BUSES) | ((F.col("buses") >= C.GARAGE_AWAY_BUSES) & (F.coalesce("end_m", F.lit(math.inf)) >= C.TERMINAL_END_M))
    verdict = F.when(garage, "garage").when(F.col("end_m") < C.TERMINAL_END_M, "terminal").otherwise("too few buses to tell")
    return groups.join(away, "root", "left").withColumn("verdict", verdict)


def garage_boxes(groups: DataFrame) -> DataFrame:
    """``buses, lat0, lon0, lat1, lon1`` of the groups that are garages, with a margin of 30 m."""
    edge = lambda c, more, m, by: F.round(((F.col(c) + more) * C.NIGHT_CELL_M + m) / by, 6)
    m, lat, lon = C.NIGHT_MARGIN_M, C.EVIDENCE_M_PER_DEGREE, _M_PER_LON
    return groups.where("verdict = 'garage'").select("root", "buses", edge("y0", 0, -m, lat).alias("lat0"), edge("x0", 0, -m, lon).alias("lon0"), edge("y1", 1, m, lat).alias("lat1"), edge("x1", 1, m, lon).alias("lon1"))
