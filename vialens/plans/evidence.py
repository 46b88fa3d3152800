"""Queries on evidence from landed pages: codes without a route, from all of them, and the garages where buses sleep, from sampled minutes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vialens.functions import geo
from vialens.operators import evidence, lookups, spatial
from vialens.operators.stored import shared_folder, stored
from vialens.plans import fixture
from vialens.plans.fixture import FX, SHAPES_SQL
from vialens.plans.registry import ORACLES, query, table
from vialens.sources import feeds, landed

#: What zirix units report as their shape: mostly that of the road they are on, at times the next road's, at times none.
SHAPE_SQL = """case when vendor = 'zirix' and event_id % 7 <> 0 then concat('s', case when event_id % 11 = 0 then (event_id % 40 % 4 + 1) % 4 else event_id % 40 % 4 end, '_',
  case when (event_id % 40 * 617 + (event_id - event_id % 40) / 40 * 150) % 24000 < 12000 then 0 else 1 end) end"""
#: Reports of 120 buses, one an hour each: two yards, a terminal, a corner where few sleep, and buses on the road.
NIGHT_SQL = """with n as (select event_id, event_id % 120 as v, (event_id - event_id % 120) / 120 as k from {events}),
p as (select *, case when v < 45 then 3000 + v % 9 * 20 when v < 70 then 8000 + v % 5 * 25 when v < 95 then 11950 + v % 5 * 22 when v < 105 then 5000 + v % 10 * 5 else (v * 617 + event_id * 31) % 12000 end as m_x,
    case when v < 45 then 700 + (v - v % 9) / 9 * 20 when v < 70 then 2200 + (v - v % 5) / 5 * 11 when v < 95 then 1480 + (v - v % 5) / 5 * 3 when v < 105 then 4000 else 1500 * (v % 3) end as m_y from n)
select concat('N', lpad(cast(v as string), 3, '0')) as vehicle, cast(1799989200 + 3600 * k as bigint) as t,
  cast(-22.9 as double) + cast(m_y as double) * cast(8.993216059187306e-06 as double) as lat, cast(-43.4 as double) + cast(m_x as double) * cast(9.762655818091652e-06 as double) as lon,
  case when v >= 105 then cast(30 as double) when event_id % 10 = 0 then cast(12 as double) when v % 3 = 0 then null else cast(v % 3 as double) end as speed from p"""


def land_fixes(spark: SparkSession, rows: DataFrame, minute: F.Column, number: F.Column) -> str:
    """Lands fixes as the feed's pages of 500 rows, a history of many minutes; the folder. Rows are dealt by range of minute and page
    once, and each task makes its pages and their file."""
    root = f"{shared_folder(spark)}/vialens-pages-{uuid.uuid4().hex}"
    iso = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    of = {"vehicle": "id_veiculo", "vendor": "fornecedor", "service": "servico", "sentido": "sentido", "lat": "latitude", "lon": "longitude", "speed": "velocidade", "shape_id": "shape_id"}
    row = F.struct(*(F.col(c).alias(n) for c, n in of.items() if c in rows.columns), iso("t").alias("datetime"))
    dealt = rows.select(minute.alias("minute"), number.cast("int").alias("page"), row.alias("row")).repartitionByRange("minute", "page")
    landed.land_history(dealt.groupBy("minute", "page").agg(F.to_json(F.struct(F.collect_list("row").alias("data"))).alias("value")), root)
    return root


_MINUTE = "yyyy-MM-dd'T'HH:mm:00'Z'"


@query(FX + "," + SHAPES_SQL.lstrip() + f""", w as (select *, {SHAPE_SQL} as shape_id from fx),
  u as (select *, lon * 111320.0 * cos(radians(-22.9)) as ex, lat * 111320.0 as ey from w where service is not null and trim(service) not in ('', '474', '7')),
  names(route_ix, route) as (values (0, '474'), (1, '007'), (2, 'LECD140')),
  road as (select route_ix, route, (-22.9 + route_ix * 1500 / 111194.92664455873) * 111320.0 as y0, -43.4 * 111320.0 * cos(radians(-22.9)) as x0, (-43.4 + 12000 / 102431.14359791845) * 111320.0 * cos(radians(-22.9)) as x1 from names),
  a as (select service, count(*) as n, count(distinct vehicle) as buses, count(distinct vendor) as vendors, count(sentido) as dirs from u group by service),
  rep as (select service, route, count(*) as c from u join shp using (shape_id) join names using (route_ix) group by all),
  cov as (select service, route, count(*) as c from u join road on sqrt(power(ey - y0, 2) + power(greatest(0, x0 - ex, ex - x1), 2)) <= 60 group by all),
  rr as (select rep.*, cast(round_even(100.0 * c / n, 0) as bigint) as pct, row_number() over (partition by service order by c desc, route) as rn from rep join a using (service)),
  cc as (select cov.*, cast(round_even(100.0 * c / n, 0) as bigint) as pct, row_number() over (partition by service order by c desc, route) as rn from cov join a using (service)),
  rt as (select service, string_agg(route || ' ' || pct || '%', ', ' order by rn) as reported, first(route order by rn) as route from rr where rn <= 2 group by service),
  ct as (select service, string_agg(route || ' ' || pct || '%', ', ' order by rn) as covered, first(route order by rn) as route, first(pct order by rn) as pct from cc where rn <= 2 group by service)
  select service, buses, a.n as sampled, coalesce(reported, '-') as reported, coalesce(covered, '-') as covered,
    case when rt.route = ct.route and ct.pct >= 85 then 'alias -> ' || ct.route when vendors = 1 and dirs < 0.1 * a.n then 'no line' else 'line without a route' end as verdict
  from a left join rt using (service) left join ct using (service)""")
def alias_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each code without a route of its own, from all landed pages: its buses, the routes that its vendors' shape ids name, those
    within 60 m of which its fixes lie, and the verdict."""
    fx = fixture.fixes(spark, sf_dir).withColumn("shape_id", F.expr(SHAPE_SQL.replace("concat('s', case", "concat('s', cast(case").replace("% 4 end, '_'", "% 4 end as string), '_'")))
    root = land_fixes(spark, fx, F.date_format(F.timestamp_seconds("seen_at"), _MINUTE), F.expr("event_id div 500"))
    fixes = feeds.fixes_of_pages(landed.all_pages(spark, root))
    known = lookups.resolve_service(fixes.where("trim(service) <> ''"), fixture.routes(spark), fixture.aliases(spark).limit(0))
    rows = known.where("route_ix is null").withColumns({"x": evidence.x_of(F.col("lon")), "y": evidence.y_of(F.col("lat")), "fix": F.monotonically_increasing_id()})
    rows = stored(rows.select("service", "vehicle", "vendor", "dir", "shape_id", "x", "y", "fix"), "unrouted")
    names = fixture.shapes(spark).join(fixture.routes(spark), "route_ix").select("shape_id", F.col("short_name").alias("route")).distinct()
    places = fixture.points(spark).withColumns({"x": evidence.x_of(geo.lon_of(F.col("x"))), "y": evidence.y_of(geo.lat_of(F.col("y")))})
    covered = evidence.shapes_near(rows, spatial.segments(places, ["shape_id"]).join(names, "shape_id"), ["service", "fix"], "route")
    return evidence.alias_verdicts(rows, rows, covered, rows.join(names, "shape_id"))


def night_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where buses stood at the sampled minutes of the last three nights."""
    rows = spark.sql(NIGHT_SQL, events=table(spark, sf_dir, "events"))
    root = land_fixes(spark, rows, F.date_format(F.timestamp_seconds("t"), _MINUTE), F.abs(F.hash("vehicle")) % 4)
    now = rows.agg(F.max("t")).first()[0] or 0
    return evidence.slow_cells(landed.read_minutes(spark, root, landed.sampled_nights(now, 3))[0])


NIGHTS = """with recursive nr as (""" + NIGHT_SQL.format(events="events") + """), nw as (select max(t) as now from nr),
  nn as (select nr.* from nr, nw where t % 86400 in (21600, 25200) and t // 86400 > now // 86400 - 3),
  st as (select distinct cast(floor(lon * 111320.0 * cos(radians(-22.9)) / 60) as bigint) as cx, cast(floor(lat * 111320.0 / 60) as bigint) as cy, vehicle from nn where coalesce(speed, 0) <= 3),
  dn as (select cx, cy, count(*) as buses, (cx + 10000000) * 100000000 + cy + 10000000 as node from st group by cx, cy having count(*) >= 6)"""
GROUPS = NIGHTS + """, e as (select a.node as a, b.node as b from dn a join dn b on abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1),
  reach(node, root) as (select node, node from dn union select e.b, reach.root from reach join e on e.a = reach.node), kk as (select node, min(root) as root from reach group by node),
  g as (select root, count(distinct node) as cells, count(distinct vehicle) as buses, min(cx) as x0, min(cy) as y0, max(cx) as x1, max(cy) as y1 from st join dn using (cx, cy) join kk using (node) group by root),
  ends as (select (-43.4 + a * 12000 / 102431.14359791845) * 111320.0 * cos(radians(-22.9)) as ex, (-22.9 + r * 1500 / 111194.92664455873) * 111320.0 as ey from range(2) t(a), range(3) u(r)),
  away as (select root, min(sqrt(power((x0 + x1 + 1) * 30.0 - ex, 2) + power((y0 + y1 + 1) * 30.0 - ey, 2))) as m from g, ends group by root),
  grp as (select g.*, round(m, 2) as end_m, case when buses >= 40 or buses >= 20 and m >= 150 then 'garage' when m < 150 then 'terminal' else 'too few buses to tell' end as verdict from g join away using (root))"""


@query(NIGHTS + " select cx, cy, buses from dn")
def garage_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 m cells in which six different buses or more stood in the sampled nights."""
    return evidence.dense_cells(night_cells(spark, sf_dir))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = fixture.points(spark).where("i in (0, 240)").select(F.concat_ws("-", "shape_id", "i").alias("end_id"), evidence.x_of(geo.lon_of(F.col("x"))).alias("x"), evidence.y_of(geo.lat_of(F.col("y"))).alias("y"))
    return evidence.garage_groups(night_cells(spark, sf_dir), ends)


@query(GROUPS + " select root, cells, buses, x0, y0, x1, y1, end_m, verdict from grp")
def garage_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of touching cells where buses stood: cells, different buses, bounds, the metres from the middle to the nearest route end, and the verdict."""
    return _groups(spark, sf_dir).withColumn("end_m", F.round("end_m", 2))


@query("select cast(row_number() over (order by buses desc, root) as int) as place, root, buses, verdict from (" + ORACLES["garage_components"] + ")")
def garage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of cells, most buses first; a city has some hundred, so one task ranks them."""
    place = F.row_number().over(Window.orderBy(F.desc("buses"), "root"))
    return _groups(spark, sf_dir).select(place.alias("place"), "root", "buses", "verdict")


@query(GROUPS + """ select root, buses, round((y0 * 60.0 - 30) / 111320.0, 6) as lat0, round((x0 * 60.0 - 30) / (111320.0 * cos(radians(-22.9))), 6) as lon0,
  round(((y1 + 1) * 60.0 + 30) / 111320.0, 6) as lat1, round(((x1 + 1) * 60.0 + 30) / (111320.0 * cos(radians(-22.9))), 6) as lon1 from grp where verdict = 'garage'""")
def garage_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the landed pages of the sampled nights to the boxes of a settings file: the garages found, with a margin."""
    return evidence.garage_boxes(_groups(spark, sf_dir))
