"""What is published of vehicle states: the snapshot, arrivals, phase counts and reasons without a direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialens import constants as C
from vialens.functions import geo


def snapshot(states: DataFrame, shapes: DataFrame, stops: DataFrame) -> DataFrame:
    """A row for each vehicle with a line: direction, next stop, speed, confidence. Whoever publishes it sorts it.

    ``shapes``: shape_id, direction, circular; ``stops``: shape_id, dist, stop_id. Both are dimensions."""
    held = stops.groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("dist", "stop_id"))).alias("stops"))
    dims = shapes.select("shape_id", "direction", "circular").join(held, "shape_id", "left")
    rows = states.where(F.trim("line") != "").join(F.broadcast(dims), "shape_id", "left")
    ahead = F.filter("stops", lambda s: s["dist"] > F.col("along") - 5)
    way = F.when(F.col("shape_id").isNull(), None).when(F.col("circular"), "circular").when(F.col("direction") == 1, "volta").otherwise("ida")
    sure = F.when(F.col("shape_id").isNotNull(), F.when(F.col("dist") <= C.CONFIDENT_M, 0.95).otherwise(0.7)).when(F.col("beam_dist") <= C.CONFIDENT_M, 0.35).otherwise(0.15)
    out = rows.select(
        F.col("vehicle").alias("id"), "line", "t", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), F.round("heading").cast("int").alias("bearing"), "phase", way.alias("dir"), "shape_id",
        F.round("along").cast("int").alias("along"), F.round(F.col("speed") * 3.6).cast("int").alias("speed_kmh"), F.try_element_at(ahead, F.lit(1))["stop_id"].alias("next_stop"), sure.alias("conf"), "vendor", "brt",
    )
    return out


def line_speeds(states: DataFrame) -> DataFrame:
    """The upper median speed of each route's committed vehicles under way, if there are three; a route has at most some hundred."""
    live = states.where((F.col("phase") == "live") & F.col("shape_id").isNotNull() & F.col("route_ix").isNotNull())
    speeds = live.groupBy("route_ix").agg(F.array_sort(F.collect_list("speed")).alias("v")).where(F.size("v") >= C.MEDIAN_OF)
    return speeds.select("route_ix", F.get("v", F.floor(F.size("v") / 2).cast("int")).alias("line_speed"))


def arrivals(states: DataFrame, shapes: DataFrame, stops: DataFrame) -> DataFrame:
    """The stops ahead of each committed vehicle under way, 25 and 8,000 m at most, with a range of seconds."""
    held = stops.groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("dist", "stop_id"))).alias("stops"))
    dims = shapes.select("shape_id", "direction", "circular", "headsign", "planned").join(held, "shape_id")
    live = states.where((F.col("phase") == "live") & F.col("shape_id").isNotNull() & F.col("route_ix").isNotNull())
    rows = live.join(F.broadcast(dims), "shape_id").join(F.broadcast(line_speeds(states)), "route_ix", "left")
    ahead = F.slice(F.filter("stops", lambda s: s["dist"] > F.col("along") - 5), 1, C.STOPS_AHEAD)
    near = F.filter(ahead, lambda s: s["dist"] - F.col("along") <= C.AHEAD_M)
    out = rows.select("*", F.posexplode(near).alias("stops_away", "s"))
    metres = F.col("s.dist") - F.col("along")
    lo, hi = geo.eta_bounds(metres, F.col("speed"), F.col("line_speed"), F.col("planned"))
    way = F.when(F.col("circular"), "circular").when(F.col("direction") == 1, "volta").otherwise("ida")
    return out.select(F.col("s.stop_id").alias("stop_id"), "line", F.col("headsign").alias("to"), way.alias("dir"), "vehicle", "t", "stops_away", F.greatest(metres, F.lit(0.0)).alias("metres"), lo.alias("eta_lo"), hi.alias("eta_hi"))


def phase_counts(states: DataFrame) -> DataFrame:
    """``key, n``: vehicles in each phase, tracked, matched, in service, and the whole percent of the last two."""
    idle = F.col("phase").isin("parked", "stale", "garage")
    one = states.agg(F.count("*").alias("tracked"), F.count("shape_id").alias("matched"), F.count_if(F.col("route_ix").isNotNull() & ~idle).alias("in_service"))
    one = one.withColumn("direction_rate_pct", F.expr("case when in_service = 0 then 0 else least(matched, in_service) * 100 div in_service end"))
    totals = one.select(F.explode(F.create_map(*(x for c in ("tracked", "matched", "in_service", "direction_rate_pct") for x in (F.lit(c), F.col(c).cast("long"))))).alias("key", "n"))
    return states.groupBy(F.col("phase").alias("key")).agg(F.count("*").alias("n")).union(totals)


def pending_reasons(states: DataFrame) -> DataFrame:
    """Why vehicles that should have a direction have none: the first reason that holds."""
    idle = F.col("phase").isin("parked", "stale", "garage")
    why = (
        F.when(F.col("route_ix").isNull(), "no_route").when(F.col("hypotheses") == 0, "no_candidate_pass").when(F.col("beam_dist") > C.TENTATIVE_M, "far_from_shape")
        .when(F.col("beam_fixes") < C.FIXES, "too_few_fixes").when(F.col("beam_progress") < C.PROGRESS_M, "not_enough_progress").otherwise("rival_pass_too_close")
    )
    return states.where(F.col("shape_id").isNull() & ~idle).groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


def pending_sample(states: DataFrame, limit: int) -> DataFrame:
    """The first vehicles by id that move at 2 m/s or more on a known route and have no direction yet, with what is known of each."""
    rows = states.where((F.col("phase") == "pending") & F.col("shape_id").isNull() & (F.col("speed") >= 2.0) & F.col("route_ix").isNotNull())
    best = F.when(F.col("hypotheses") > 0, F.format_string("dist=%.0f prog=%.0f fixes=%d", "beam_dist", "beam_progress", "beam_fixes")).otherwise("no hypothesis")
    return rows.orderBy("vehicle").limit(limit).select("vehicle", "service", "hypotheses", "accepted", "resets", F.round("speed", 1).alias("speed"), best.alias("best"))
