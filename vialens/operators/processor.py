"""The state of a vehicle and how a fix changes it; the same step serves batches and streams."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialens import constants as C
from vialens.operators.matcher import FAR, Hyp, Motion, Shape, advance, committed

_OUT = {w.upper() for w in C.OUT_OF_SERVICE} | set(C.OUT_OF_SERVICE)


@dataclass
class Network:
    """Static tables as a vehicle's step needs them; a few thousand shapes, shipped to tasks once in the closure."""

    shapes: dict[str, Shape]
    lines: dict[str, int]
    names: dict[int, str]
    trips: dict[str, str] = field(default_factory=dict)
    not_service: frozenset[str] = frozenset()
    garages: list[tuple[float, float, float, float]] = field(default_factory=list)

    @cached_property
    def by_route(self) -> dict[int, list[Shape]]:
        """The shapes of each route, in their order."""
        out: dict[int, list[Shape]] = {}
        for s in self.shapes.values():
            out.setdefault(s.route_ix, []).append(s)
        return out

    def route_of(self, code: str) -> int | None:
        code = code.strip()
        bare = code.lstrip("0")
        return next((self.lines[k] for k in (code, bare, bare.rjust(3, "0")) if k in self.lines), None)

    def of_route(self, route: int | None) -> list[Shape]:
        return self.by_route.get(route, [])

    def yard(self, x: float, y: float) -> bool:
        return any(a <= x <= c and b <= y <= d for a, b, c, d in self.garages)


@lru_cache(100_000)
def service_kind(code: str | None) -> str:
    s = (code or "").strip()
    if not s:
        return "unknown"
    up = re.sub("[a-z]+", lambda m: m[0].upper(), s)
    parts = re.split("[^A-Z0-9]", up)
    out = not s.strip("0") or up in _OUT or any(w == "GAR" or w.startswith("GARAG") for w in parts)
    return "out" if out else "named"


@dataclass
class Vehicle:
    """What is remembered of a vehicle. ``t`` of 0: nothing accepted yet."""

    t: int = 0
    lat: float = 0.0
    lon: float = 0.0
    x: float = 0.0
    y: float = 0.0
    vendor: str = ""
    heading: float | None = None
    service: str = ""
    route: int | None = None
    hint: str | None = None
    brt: bool = False
    beam: list[Hyp] = field(default_factory=list)
    fixed: Hyp | None = None
    phase: str = "pending"
    speed: float = 0.0
    accepted: int = 0
    resets: int = 0
    units: dict[str, tuple[int, float, float]] = field(default_factory=dict)
    sampled: tuple[int, float, float] | None = None
    moved: tuple[int, float, float] | None = None
    off_since: int | None = None
    slow: int = 0
    fast: int = 0

    @classmethod
    def load(cls, text: str) -> Vehicle:
        d = json.loads(text)
        d["beam"], d["fixed"] = [Hyp(*h) for h in d["beam"]], Hyp(*d["fixed"]) if d["fixed"] else None
        d["units"] = {k: tuple(v) for k, v in d["units"].items()}
        d |= {k: tuple(d[k]) if d[k] else None for k in ("sampled", "moved")}
        return cls(**d)

    def dump(self) -> str:
        return json.dumps(asdict(self) | {"beam": [list(h) for h in self.beam], "fixed": list(self.fixed) if self.fixed else None})


@dataclass
class Tracker:
    """All that a key of the stream keeps: the vehicle, if one is known, and the reports of the last ten minutes."""

    net: Network
    vehicle: Vehicle | None = None
    seen: dict[str, int] = field(default_factory=dict)
    unmatched: int = 0

    def dump(self) -> str:
        return json.dumps({"vehicle": self.vehicle.dump() if self.vehicle else None, "seen": self.seen, "unmatched": self.unmatched})

    @classmethod
    def load(cls, net: Network, text: str) -> Tracker:
        d = json.loads(text)
        return cls(net, Vehicle.load(d["vehicle"]) if d["vehicle"] else None, d["seen"], d["unmatched"])

    def tick(self, now: int) -> None:
        """Ages the vehicle: stale after 180 s of silence, forgotten after 300 s."""
        v = self.vehicle
        if v and now - v.t > C.DROP_S:
            self.vehicle = None
        elif v and now - v.t > C.STALE_S:
            v.phase = "stale"
        self.seen = {k: s for k, s in self.seen.items() if now - s < C.DEDUPE_S}

    def step(self, fix: dict, now: int) -> str:
        """Applies a fix and says what became of it; the first rule that it breaks decides."""
        kind = service_kind(fix.get("service"))
        if not (C.AREA_LAT[0] <= fix["lat"] <= C.AREA_LAT[1] and C.AREA_LON[0] <= fix["lon"] <= C.AREA_LON[1]):
            return "outside"
        if fix["t"] > now + C.FUTURE_S:
            return "future"
        if kind == "out" or (fix.get("service") or "").strip() in self.net.not_service:
            self.vehicle = None
            return "out_of_service"
        if kind == "unknown" and not (self.vehicle and self.vehicle.service):
            return "unknown_service"
        report = f"{fix['vendor']}|{fix['t']}"
        if now - self.seen.get(report, -C.DEDUPE_S) < C.DEDUPE_S:
            return "duplicate"
        self.seen[report] = now
        if len(self.seen) > 256:
            self.seen = {k: s for k, s in self.seen.items() if now - s < C.DEDUPE_S}
        if now - fix["t"] > C.TOO_OLD_S:
            return "too_old"
        v = self.vehicle = self.vehicle or Vehicle(lat=fix["lat"], lon=fix["lon"])
        if v.t and fix["t"] <= v.t:
            return "not_newer"
        x, y = (fix["lon"] - C.ANCHOR_LON) * C.M_PER_LON, (fix["lat"] - C.ANCHOR_LAT) * C.M_PER_LAT
        unit = v.units.get(fix["vendor"])
        if unit and fix["t"] > unit[0] and math.hypot(x - unit[1], y - unit[2]) / (fix["t"] - unit[0]) > C.MAX_SPEED_MS:
            return "jump"
        before = (v.t, v.x, v.y)
        self._remember(v, fix, x, y, kind)
        self._place(v, fix, before, unit)
        v.phase = self._phase(v, now)
        if v.route is None and not fix.get("shape_id") and not fix.get("trip_id"):
            self.unmatched += 1
        return "accepted"

    def _remember(self, v: Vehicle, fix: dict, x: float, y: float, kind: str) -> None:
        here = (fix["t"], x, y)
        v.units[fix["vendor"]] = here
        v.accepted += 1
        v.vendor, v.t, v.lat, v.lon, v.x, v.y = fix["vendor"], fix["t"], fix["lat"], fix["lon"], x, y
        v.brt = v.brt or bool(fix.get("brt"))
        v.heading = v.heading if fix.get("heading") is None else fix["heading"]
        if kind == "named" and fix["service"] != v.service:  # the trip before is over
            v.service, v.route = fix["service"], self.net.route_of(fix["service"])
            v.beam, v.fixed, v.phase = [], None, "pending"
            v.resets += 1
        v.hint = fix.get("dir") or v.hint
        if v.moved is None or math.hypot(x - v.moved[1], y - v.moved[2]) > C.PARKED_M:
            v.moved = here
        if v.sampled is None:
            v.sampled = here
        elif (dt := fix["t"] - v.sampled[0]) >= C.MIN_GAP_S:
            now = min(math.hypot(x - v.sampled[1], y - v.sampled[2]) / dt, C.MAX_SPEED_MS)
            v.speed += (1.0 - 0.5 ** (dt / C.HALF_LIFE_S)) * (now - v.speed)
            v.sampled = here

    def _candidates(self, v: Vehicle, fix: dict) -> tuple[list[Shape], list[Shape]]:
        """Shapes to try, and those to fall back on: a named shape, else that of the trip, else the route's of the direction."""
        every = self.net.of_route(v.route) if v.route is not None else []
        if (s := self.net.shapes.get(fix.get("shape_id") or "")) is not None:
            return [s], every
        if (s := self.net.shapes.get(self.net.trips.get(fix.get("trip_id") or "", ""))) is not None:
            return [s], []
        want = {"ida": 0, "volta": 1}.get(fix.get("dir") or v.hint or "")
        some = [s for s in every if want is None or s.direction == want]
        return (every, []) if not some or len(some) == len(every) else (some, every)

    def _place(self, v: Vehicle, fix: dict, before: tuple[int, float, float], unit: tuple[int, float, float] | None) -> None:
        first, fallback = self._candidates(v, fix)
        if not first:
            return
        travelled, usable = 0.0, False
        if before[0]:
            travelled = math.hypot(v.x - before[1], v.y - before[2])
            usable = v.t - before[0] >= C.MIN_GAP_S or bool(unit and unit[0] == before[0])
        tracked = [self.net.shapes[i] for i in dict.fromkeys(h.shape for h in v.beam) if all(s.id != i for s in first)]
        motion = Motion(v.x, v.y, travelled, usable, v.heading if v.speed > C.MOVING_MS else None)
        had = bool(v.beam)
        v.beam = advance(v.beam, first + tracked, motion)
        if fallback and (not v.beam or v.beam[0].dist == FAR):
            v.beam = advance(v.beam, fallback, motion)
        if had and v.beam and v.beam[0].fixes == 0:
            v.resets += 1
        if (best := committed(v.beam)) is not None:
            v.fixed = best
        elif v.fixed:  # through a tie, follow the best hypothesis on the committed shape
            v.fixed = next((h for h in v.beam if h.shape == v.fixed.shape), v.fixed)

    def _phase(self, v: Vehicle, now: int) -> str:
        if self.net.yard(v.x, v.y) and all(h.dist > C.GARAGE_ROUTE_M for h in v.beam):
            return "garage"
        if not v.beam or v.beam[0].dist > C.TENTATIVE_M:
            v.off_since = now if v.off_since is None else v.off_since
            if now - v.off_since > C.OFF_ROUTE_S:
                return "offroute"
        else:
            v.off_since = None
        if v.fixed is None:
            return "offroute" if v.phase == "offroute" else "parked" if v.moved and now - v.moved[0] > C.PARKED_S else "pending"
        a, end, slow = v.fixed.along, self.net.shapes[v.fixed.shape].length - C.TERMINAL_M, v.speed < C.STOPPED_MS
        if v.phase == "layover":
            v.fast = min(v.fast + 1, 255) if C.TERMINAL_M + 100.0 < a < end and not slow else 0
            if v.fast < 2:
                return "layover"
            v.slow = 0
            return "live"
        v.slow = min(v.slow + 1, 255) if slow and (a < C.TERMINAL_M or a > end) else 0
        if v.slow < 2:
            return "live"
        v.fast = 0
        return "layover"


STATE = "vehicle string, t long, lat double, lon double, service string, route_ix int, line string, phase string, shape_id string, along double, dist double, beam_dist double, beam_fixes int, beam_progress double, hypotheses int, speed double, heading double, vendor string, brt boolean, accepted int, resets int, unmatched int"
OUTCOME = "event_id long, vehicle string, outcome string, phase string, shape_id string, along double"


def state_row(vehicle: str, k: Tracker) -> dict | None:
    v = k.vehicle
    if v is None:
        return None
    best = v.beam[0] if v.beam else None
    return {
        "vehicle": vehicle, "t": v.t, "lat": v.lat, "lon": v.lon, "service": v.service, "route_ix": v.route, "line": k.net.names.get(v.route, v.service) if v.route is not None else v.service,
        "phase": v.phase, "shape_id": v.fixed.shape if v.fixed else None, "along": v.fixed.along if v.fixed else None, "dist": v.fixed.dist if v.fixed else None,
        "beam_dist": best.dist if best else None, "beam_fixes": best.fixes if best else None, "beam_progress": best.progress if best else None, "hypotheses": len(v.beam),
        "speed": v.speed, "heading": v.heading, "vendor": v.vendor, "brt": v.brt, "accepted": v.accepted, "resets": v.resets, "unmatched": k.unmatched,
    }


def _frame(rows: list[dict] | list[tuple], schema: str) -> pd.DataFrame:
    kinds = {"string": object, "long": "Int64", "int": "Int32", "double": "float64", "boolean": object}
    cols = [c.split() for c in schema.split(", ")]
    return pd.DataFrame(rows, columns=[n for n, _ in cols]).astype({n: kinds[k] for n, k in cols})


def _clean(row: dict) -> dict:
    return {k: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v for k, v in row.items()}


def replay(fixes: DataFrame, net: Network, emit: str = "states", at_end: int | None = None) -> DataFrame:
    """Runs every vehicle's fixes through its state in the order of arrival.

    ``emit``: "outcomes" gives a row for each fix, "states" one for each vehicle after its last fix, aged to the clock ``at_end``
    if given. Rows are dealt by vehicle and sorted, and a task holds one vehicle's state at a time, however long its history.
    """
    names = [c for c in ("event_id", "vehicle", "vendor", "t", "seen_at", "lat", "lon", "service", "heading", "dir", "shape_id", "trip_id", "brt") if c in fixes.columns]
    schema = OUTCOME if emit == "outcomes" else STATE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, k = None, Tracker(net)

        def end() -> list[dict]:
            if who is None or emit != "states":
                return []
            if at_end is not None:
                k.tick(at_end)
            return [r for r in [state_row(who, k)] if r]

        for b in batches:
            out = []
            for values in zip(*(b[c].astype(object).where(b[c].notna(), None).tolist() for c in names), strict=True):
                fix = dict(zip(names, values, strict=True))
                if fix["vehicle"] != who:
                    out += end()
                    who, k = fix["vehicle"], Tracker(net)
                elif k.vehicle and fix["seen_at"] - k.vehicle.t > C.STALE_S:
                    k.tick(fix["seen_at"])
                outcome = k.step(fix, fix["seen_at"])
                if emit == "outcomes":
                    v = k.vehicle
                    out.append((fix["event_id"], who, outcome, v.phase if v else None, v.fixed.shape if v and v.fixed else None, v.fixed.along if v and v.fixed else None))
            yield _frame(out, schema)
        yield _frame(end(), schema)

    order = ["vehicle", "seen_at", "t", *(["event_id"] if "event_id" in names else [])]
    return fixes.select(*names).repartition("vehicle").sortWithinPartitions(*order).mapInPandas(run, schema)


def network(points: DataFrame, stops: DataFrame, routes: DataFrame, aliases: DataFrame, **more) -> Network:
    """A network collected from dimension tables: a city's shapes, some thousand rows of points each."""
    shapes = {}
    rows = points.groupBy("shape_id", "route_ix", "direction").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y", "cum"))).alias("p")).collect()
    held = {r["shape_id"]: r["s"] for r in stops.groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("dist", "stop_id"))).alias("s")).collect()}
    for r in rows:
        x, y, cum = (np.asarray([p[c] for p in r["p"]], float) for c in ("x", "y", "cum"))
        shapes[r["shape_id"]] = Shape(r["shape_id"], r["route_ix"], r["direction"], x, y, cum, stops=[(s["dist"], s["stop_id"]) for s in held.get(r["shape_id"], [])])
    named = {r["short_name"]: r["route_ix"] for r in routes.collect()}
    lines = named | {a["alias"]: named[a["target"]] for a in aliases.collect() if a["target"] in named}
    return Network(dict(sorted(shapes.items())), lines, {ix: n for n, ix in named.items()}, **more)
