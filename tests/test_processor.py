"""Scenarios on straight and doubled-back shapes, with explicit clocks."""

import numpy as np
import pytest

from vialens import constants as C
from vialens.operators.matcher import FAR, Hyp, Motion, Shape, advance, committed
from vialens.operators.processor import Network, Tracker, Vehicle, service_kind

T0 = 1_800_000_000


def straight(name="s0", route=0, direction=0, y=0.0, n=81, circular=False):
    x = np.arange(n) * 50.0
    return Shape(name, route, direction, x if direction == 0 else x[::-1].copy(), np.full(n, y), np.arange(n) * 50.0, circular, stops=[(1000.0 * k, f"p{k}") for k in range(5)])


def out_and_back():
    x = np.concatenate([np.arange(41) * 50.0, np.arange(40, -1, -1) * 50.0])
    y = np.concatenate([np.zeros(41), np.full(41, 20.0)])
    cum = np.concatenate([[0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))])
    return Shape("ob", 0, 0, x, y, cum)


def net(*shapes, **more):
    return Network({s.id: s for s in shapes or (straight(),)}, {"474": 0, "007": 1}, {0: "474", 1: "007"}, **more)


def fix(x, t, y=0.0, service="474", vendor="zirix", **more):
    return {"vehicle": "A1", "vendor": vendor, "t": t, "lat": C.ANCHOR_LAT + y / C.M_PER_LAT, "lon": C.ANCHOR_LON + x / C.M_PER_LON, "service": service} | more


def drive(k, places, start=T0, every=30, **more):
    return [k.step(fix(x, start + every * i, **more), start + every * i) for i, x in enumerate(places)]


def test_moving_vehicle_commits():
    k = Tracker(net())
    assert drive(k, [1500, 1650, 1800, 1950]) == ["accepted"] * 4
    v = k.vehicle
    assert v.phase == "live" and v.fixed.shape == "s0" and v.speed * 3.6 > 10
    s = k.net.shapes["s0"]
    assert s.stops[s.next_stop(v.fixed.along)][1] == "p2"


@pytest.mark.parametrize("code", ["GARAGEM", "3", "000", "1 GAR", "Manutenção"])
def test_out_of_service_forgets_the_vehicle(code):
    k = Tracker(net(not_service=frozenset(["3"])))
    drive(k, [0, 150])
    assert k.step(fix(300, T0 + 60, service=code), T0 + 60) == "out_of_service" and k.vehicle is None


def test_repeat_other_unit_and_late():
    k = Tracker(net())
    assert k.step(fix(0, T0), T0) == "accepted"
    assert k.step(fix(0, T0), T0 + 5) == "duplicate"
    assert k.step(fix(0, T0, vendor="sonda"), T0 + 5) == "not_newer"
    assert k.step(fix(0, T0 - 7200), T0 + 5) == "too_old"
    assert k.step(fix(0, T0 + 100), T0 + 5) == "future"
    assert k.step(fix(200_000, T0 + 5), T0 + 5) == "outside"


def test_jump_is_judged_against_the_same_unit():
    k = Tracker(net())
    k.step(fix(0, T0), T0)
    assert k.step(fix(4000, T0 + 10), T0 + 10) == "jump"
    assert k.step(fix(80, T0 + 2, vendor="sonda"), T0 + 10) == "accepted"


def test_silence():
    k = Tracker(net())
    drive(k, [0, 150])
    k.tick(T0 + 30 + 181)
    assert k.vehicle.phase == "stale"
    k.tick(T0 + 30 + 301)
    assert k.vehicle is None


def test_layover_at_the_terminal():
    k = Tracker(net())
    drive(k, [3000, 3200, 3400, 3600, 3800, 3900])
    drive(k, [3950] * 16, start=T0 + 180)
    assert k.vehicle.phase == "layover"


def test_units_that_name_different_shapes_still_commit():
    k = Tracker(net(straight("s0"), straight("s1", direction=1)))
    for i in range(20):
        k.step(fix(500 + 120 * i, T0 + 20 * i, vendor="zirix" if i % 2 else "sonda", shape_id="s0" if i % 2 else None), T0 + 20 * i)
    assert k.vehicle.fixed.shape == "s0" and k.vehicle.resets * 3 < k.vehicle.accepted


def test_blank_service_keeps_the_line():
    k = Tracker(net())
    assert k.step(fix(0, T0, service=None), T0) == "unknown_service"
    for i in range(8):
        k.step(fix(150 * i, T0 + 30 * (i + 1), service="474" if i % 2 == 0 else " "), T0 + 30 * (i + 1))
    assert k.vehicle.service == "474" and k.vehicle.fixed is not None


def test_parked_and_garage():
    k = Tracker(net())
    drive(k, [500.0] * 25)
    assert k.vehicle.phase == "parked"
    k = Tracker(net(garages=[(900.0, 60.0, 1100.0, 200.0)]))
    drive(k, [1000.0] * 3, y=120.0)
    assert k.vehicle.phase == "garage"
    k = Tracker(net(garages=[(900.0, -50.0, 1100.0, 200.0)]))
    drive(k, [700, 850, 1000, 1050], y=5.0)
    assert k.vehicle.phase == "live"


def test_unknown_line_is_tracked():
    k = Tracker(net())
    drive(k, [0], service="959")
    assert k.vehicle.route is None and k.vehicle.fixed is None and k.unmatched == 1


def test_state_survives_storage():
    k = Tracker(net())
    drive(k, [1500, 1650, 1800, 1950])
    again = Tracker.load(k.net, k.dump())
    assert again.vehicle == k.vehicle and again.seen == k.seen
    assert Vehicle.load(k.vehicle.dump()).dump() == k.vehicle.dump()


def test_passes():
    s = out_and_back()
    assert [len(s.passes(1000, 0, r)) for r in (10, 60)] == [1, 2] and s.passes(1000, 5000) == []
    assert sorted(round(a / 1000) for _, a in s.passes(1000, 10, 60)) == [1, 3]


def test_beam_rules():
    s = straight()
    beam = advance([], [s], Motion(1000, 10, 0, False, None))
    assert beam[0].fixes == 0 and committed(beam) is None
    for i in range(1, 4):
        beam = advance(beam, [s], Motion(1000 + 100 * i, 10, 100, True, None))
    assert committed(beam).along == pytest.approx(1300)
    lost = advance(beam, [s], Motion(1300, 5000, 100, True, None))
    assert lost[0].dist == FAR and committed(lost) is None
    back = advance(beam, [s], Motion(1000, 10, 300, True, None))
    assert back[0].progress == 0
    assert committed([Hyp("a", 0, 0, 10, 1, 200, 5), Hyp("b", 0, 0, 20, 1, 200, 5)]) is None
    assert committed([Hyp("a", 0, 0, 10, 1, 200, 5), Hyp("b", 0, 0, 26, 1, 200, 5)]) is not None


def test_heading_tells_directions_apart():
    pair = [straight("out"), straight("in", direction=1)]
    beam = advance([], pair, Motion(1000, 0, 0, False, 270.0))
    assert beam[0].shape == "in"


def test_loop_gap():
    s = straight(circular=True)
    assert s.gap(3900, 100) == pytest.approx(200) and s.gap(100, 3900) == pytest.approx(-200)


def test_service_kinds():
    assert [service_kind(c) for c in ("", None, "0", "GAR-9", "MANGAR", "474")] == ["unknown", "unknown", "out", "out", "named", "named"]


def test_batch_equals_steps(spark):
    from vialens.operators import processor

    rows = [fix(1500 + 100 * i, T0 + 20 * i) | {"event_id": i, "seen_at": T0 + 20 * i + 5} for i in range(12)]
    names = "event_id long, vehicle string, vendor string, t long, seen_at long, lat double, lon double, service string"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in names.split(", ")) for r in rows], names)
    n, k = net(), Tracker(net())
    outcomes = [k.step(r, r["seen_at"]) for r in rows]
    got = processor.replay(df, n, "outcomes").orderBy("event_id").collect()
    assert [r["outcome"] for r in got] == outcomes and got[-1]["along"] == pytest.approx(k.vehicle.fixed.along)
    state = processor.replay(df, n, "states").collect()
    assert len(state) == 1 and state[0]["accepted"] == 12


def test_eta(spark):
    from pyspark.sql import functions as F

    from vialens.functions import geo

    lo, hi = geo.eta_bounds(F.col("a"), F.col("own"), F.col("line"), F.col("planned"))
    rows = spark.createDataFrame([(3000.0, 5.56, 5.56, 6.0), (3000.0, 0.0, None, 6.0), (8000.0, 1.0, 10.0, 6.0)], "a double, own double, line double, planned double").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert rows[0]["lo"] < 540 < rows[0]["hi"] and rows[0]["hi"] - 540 > 540 - rows[0]["lo"]
    assert rows[1]["hi"] < 1.4 * 3000 / (8 / 3.6) + 31 and rows[2]["lo"] < 8000 / 8.0
