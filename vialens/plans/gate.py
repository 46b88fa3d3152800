"""The stateful gate: what becomes of each fix, vehicle by vehicle, with a recursive SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialens.operators import processor
from vialens.plans import matching
from vialens.plans.fixture import FX
from vialens.plans.registry import ORACLES, query

#: ``gate``: every report in the order of arrival with its outcome, in DuckDB. A vehicle's state is whether it is known, its
#: service, time, last place of each unit, and the reports of the last 600 s.
GATE_SQL = "with recursive " + FX.removeprefix("with ") + """,
rep as (select * from fx union all select * replace (seen_at + 1 as seen_at) from fx where event_id % 50 = 0),
o as (select vehicle, event_id, vendor, t, seen_at, service, (lon - -43.4) * 102431.14359791845 as x, (lat - -22.9) * 111194.92664455873 as y, row_number() over (partition by vehicle order by seen_at, t, event_id) as k,
  case when not (lat between -23.15 and -22.65 and lon between -43.9 and -43.0) then 'outside' when t > seen_at + 60 then 'future' when service = 'GARAGEM' then 'out_of_service' end as base from rep),
gate as (
  select vehicle, cast(0 as bigint) as k, cast(null as bigint) as event_id, cast('' as varchar) as outcome, false as known, '' as service, cast(0 as bigint) as t,
    cast([] as struct(v varchar, t bigint, x double, y double)[]) as units, cast([] as struct(r varchar, s bigint)[]) as seen from (select distinct vehicle from o)
  union all
  select vehicle, k, event_id, outcome, case outcome when 'out_of_service' then false when 'accepted' then true else was end, case when outcome = 'accepted' and service is not null then service else had end, case when outcome = 'accepted' then t else last_t end,
    case when outcome = 'accepted' then list_append(list_filter(us, lambda u: u.v <> vendor), {'v': vendor, 't': t, 'x': x, 'y': y}) else us end,
    case when outcome in ('too_old', 'not_newer', 'jump', 'accepted') then list_append(list_filter(sn, lambda e: seen_at - e.s < 600), {'r': concat(vendor, '|', t), 's': seen_at}) else sn end
  from (select *, case when base is not null then base when service is null and had = '' then 'unknown_service' when len(list_filter(sn, lambda e: e.r = concat(vendor, '|', t) and seen_at - e.s < 600)) > 0 then 'duplicate'
      when seen_at - t > 300 then 'too_old' when was and t <= last_t then 'not_newer' when unit is not null and t > unit.t and sqrt(power(x - unit.x, 2) + power(y - unit.y, 2)) / (t - unit.t) > 27 then 'jump' else 'accepted' end as outcome
    from (select *, list_filter(us, lambda u: u.v = vendor)[1] as unit
      from (select o.*, g.known and o.seen_at - g.t <= 300 as was, case when g.known and o.seen_at - g.t <= 300 then g.service else '' end as had, case when g.known and o.seen_at - g.t <= 300 then g.t else 0 end as last_t,
          case when g.known and o.seen_at - g.t <= 300 then g.units else cast([] as struct(v varchar, t bigint, x double, y double)[]) end as us, g.seen as sn from gate g join o on o.vehicle = g.vehicle and o.k = g.k + 1))))"""

#: The query itself is registered with the other queries on vehicle states.
ORACLES["fix_outcomes"] = GATE_SQL + " select outcome, count(*) as n from gate where k > 0 group by outcome"


@query(GATE_SQL + " select vehicle, outcome, count(*) as n, min(event_id) as first_event, max(event_id) as last_event from gate where k > 0 group by all")
def service_state_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixes of each vehicle by what became of them: the first rule broken, of those that need its state too."""
    rows = processor.replay(matching.reports(spark, sf_dir), matching.fleet_network(spark), "outcomes")
    return rows.groupBy("vehicle", "outcome").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
