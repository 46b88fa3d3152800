"""Queries on what a publishing cycle writes: the fleet's merged table, documents by line, cell and fleet, and their digests.

The snapshot is that of each vehicle's newest good fix with its line, so that SQL can state it; the matched states go through the
same documents in ``tests/test_cycle.py``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialens.constants import STALE_S
from vialens.operators import documents
from vialens.operators.stored import shared_folder
from vialens.plans import fixture
from vialens.plans.fixture import FX, LATEST_SQL
from vialens.plans.fleet import ON_ROAD, on_road
from vialens.plans.registry import query, table
from vialens.sources.files import write_documents
from vialens.streaming.keyed import KeyedTable

ZOOM = 11
SNAP_SQL = ON_ROAD + """, clock as (select 1800000000 + 20 * max(event_id // 40) as now from events),
snap as (select vehicle as id, coalesce(line, service) as line, t, lat, lon, cast(round(heading) as int) as bearing, case when now - t > 180 then 'stale' else 'live' end as phase, sentido as dir, vendor from resolved, clock),
rec as (select *, ',"t":' || t || ',"lat":' || printf('%.5f', lat) || ',"lon":' || printf('%.5f', lon) || ',"ph":"' || phase || '","brg":' || coalesce(bearing::varchar, 'null')
  || coalesce(',"dir":"' || dir || '"', '') || ',"spd":0,"cnf":0.15,"ven":"' || vendor || '"}' as tail from snap),
full_ as (select *, '{"id":' || to_json(id)::varchar || ',"line":' || to_json(line)::varchar || tail as record, '{"id":' || to_json(id)::varchar || tail as short_ from rec),
known as (select short_name as line from routes union all select '88/A'),
names as (select regexp_replace(line, '[^A-Za-z0-9_.-]', '_', 'g') as name from known union select regexp_replace(line, '[^A-Za-z0-9_.-]', '_', 'g') from snap)"""
LINES_DOC = """select 'api/v1/lines/' || name || '.json' as path, '[' || coalesce(string_agg(short_, ',' order by line, id), '') || ']' as body
  from names left join full_ on regexp_replace(line, '[^A-Za-z0-9_.-]', '_', 'g') = name group by name"""
CELLS_DOC = """select 'api/v1/cells/11/' || cx || '/' || cy || '/vehicles.json' as path, '[' || coalesce(string_agg(record, ',' order by line, id), '') || ']' as body
  from (select a as cx, b as cy from range(774, 780) x(a), range(1156, 1160) y(b)) left join
    (select *, cast(floor((lon + 180) / 360 * 2048) as int) as tx, cast(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 2048) as int) as ty from full_) on tx = cx and ty = cy group by cx, cy"""
FLEET_DOC = "select 'api/v1/fleet.json' as path, '[' || coalesce(string_agg(record, ',' order by line, id), '') || ']' as body from full_"
LIVE_DOC = """select 'api/v1/live-lines.json' as path, '[' || coalesce(string_agg('[' || to_json(line)::varchar || ',' || n || ',' || (line in (select line from known))::int || ']', ',' order by n desc, line), '') || ']' as body
  from (select line, count(*) as n from snap where phase not in ('stale', 'parked', 'garage') group by line)"""


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published snapshot of vehicles that nobody has matched to a shape yet."""
    now = table(spark, sf_dir, "events").agg((F.lit(1800000000) + 20 * F.expr("max(event_id div 40)")).alias("now"))
    none = {c: F.lit(None).cast(t) for c, t in (("shape_id", "string"), ("along", "int"), ("next_stop", "string"))}
    rows = on_road(spark, sf_dir).join(F.broadcast(now)).withColumns(none)  # one row
    phase = F.when(F.col("now") - F.col("t") > STALE_S, "stale").otherwise("live")
    return rows.select(
        F.col("vehicle").alias("id"), F.col("shown").alias("line"), "t", "lat", "lon", F.round("heading").cast("int").alias("bearing"), phase.alias("phase"), F.col("sentido").alias("dir"),
        "shape_id", "along", F.lit(0).alias("speed_kmh"), "next_stop", F.lit(0.15).alias("conf"), "vendor", F.lit(False).alias("brt"),
    )


def known_lines(spark: SparkSession) -> DataFrame:
    return fixture.routes(spark).select(F.col("short_name").alias("line")).union(spark.createDataFrame([("88/A",)], "line string"))


@query(FX + ", " + LATEST_SQL + " select vehicle, t, event_id, service, vendor from latest")
def merged_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fleet's table after four merges of a day's fixes in the order of arrival, the second handed over twice: each vehicle's newest fix."""
    rows = fixture.good_fixes(fixture.fixes(spark, sf_dir)).select("vehicle", "t", "event_id", "service", "vendor", "seen_at")
    lo, hi = rows.agg(F.min("seen_at"), F.max("seen_at")).first()
    fleet = KeyedTable(spark, f"{shared_folder(spark)}/vialens-fleet-{uuid.uuid4().hex}", ["vehicle"], "vehicle string, t long, event_id long, service string, vendor string")
    if lo is None:
        return fleet.read()
    quarter = F.least(F.lit(3), F.floor((F.col("seen_at") - lo) * 4 / max(hi - lo, 1)))
    for batch in (0, 1, 1, 2, 3):
        old = fleet.read().select("vehicle", F.col("t").alias("had"), F.col("event_id").alias("had_id"))
        new = rows.where(quarter == batch).join(old, "vehicle", "left").where("had is null or t > had or t = had and event_id > had_id")
        fleet.merge(new.drop("had", "had_id", "seen_at"), batch, newest=["t", "event_id"])
    return fleet.read()


@query(SNAP_SQL + " " + LINES_DOC)
def line_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vehicles of each line, known lines without any and seen lines that are not known included."""
    return documents.line_documents(snapshot(spark, sf_dir), known_lines(spark))


@query(SNAP_SQL + " " + CELLS_DOC)
def cell_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vehicles of each map cell of the area, empty cells included."""
    return documents.cell_documents(snapshot(spark, sf_dir), ZOOM)


@query(SNAP_SQL + " " + FLEET_DOC)
def fleet_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole fleet in full records."""
    return documents.fleet_document(snapshot(spark, sf_dir))


@query(SNAP_SQL + " " + LIVE_DOC)
def live_lines_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with vehicles on the road, how many, and whether the schedule knows them."""
    return documents.live_lines_document(snapshot(spark, sf_dir), known_lines(spark))


@query(SNAP_SQL + f", every as ({LINES_DOC} union all {CELLS_DOC} union all {FLEET_DOC} union all {LIVE_DOC}) select path, md5(body) as digest, cast(octet_length(encode(body)) as bigint) as size from every")
def published_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies published after two cycles, of which the first saw a part of the fleet only: each path with its digest and size."""
    root = f"{shared_folder(spark)}/vialens-public-{uuid.uuid4().hex}"
    done = KeyedTable(spark, f"{root}/published", ["path"], "path string, digest string, size long")
    snap, lines = snapshot(spark, sf_dir), known_lines(spark)
    for k, rows in enumerate((snap.where("id < 'V020'"), snap)):
        parts = [documents.line_documents(rows, lines), documents.cell_documents(rows, ZOOM), documents.fleet_document(rows), documents.live_lines_document(rows, lines)]
        every = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
        write_documents(every, f"{root}/public", done, k)
    return done.read()
