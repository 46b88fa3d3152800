import json

import pytest

from vialens.functions import geo
from vialens.sources import settings


def test_service_table(spark, tmp_path):
    aliases, codes = settings.service_table(spark, f"file://{tmp_path}/none.json")
    assert aliases.count() == codes.count() == 0
    (tmp_path / "s.json").write_text(json.dumps({"aliases": {"11": "LECD9", "LECD5": "22", "33": "nowhere", "22": "LECD9", "12": "LECD9"}, "not_service": [" 3 ", "OFF"]}, indent=1))
    aliases, codes = settings.service_table(spark, f"file://{tmp_path}/s.json")
    assert {r["code"] for r in codes.collect()} == {"3", "OFF"}
    routes = spark.createDataFrame([(0, "LECD9"), (1, "22")], "route_ix int, short_name string")
    got = {r["alias"]: (r["problem"], r["short_name"]) for r in settings.judged_aliases(aliases, routes).collect()}
    assert got == {"11": (None, "11"), "12": (None, "11"), "LECD5": (None, "22"), "33": ("no such route", None), "22": ("already another route", None)}


def test_damaged_file_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"aliases": {"1": ')
    with pytest.raises(Exception):
        settings.service_table(spark, f"file://{tmp_path}/bad.json")[0].collect()


def test_garage_boxes_round_trip(spark, tmp_path):
    boxes = spark.createDataFrame([(10.0, -20.0, 30.0, 40.0, 7), (100.0, 0.0, 160.0, 90.0, 44)], "x0 double, y0 double, x1 double, y1 double, buses int")
    path = f"file://{tmp_path}/g"
    settings.write_garages(boxes, path)
    got = [tuple(round(v, 4) for v in r) for r in settings.garage_boxes(spark, path).collect()]
    assert got == [(100.0, 0.0, 160.0, 90.0, 44), (10.0, -20.0, 30.0, 40.0, 7)]
    lat, lon = spark.range(1).select(geo.lat_of(geo.F.lit(40.0)), geo.lon_of(geo.F.lit(10.0))).first()
    (tmp_path / "h.json").write_text(json.dumps({"garages": [{"buses": 7, "lat0": lat, "lon0": lon, "lat1": -22.9, "lon1": -43.4}]}))
    assert [tuple(round(v, 3) + 0 for v in r) for r in settings.garage_boxes(spark, f"file://{tmp_path}/h.json").collect()] == [(0, 0, 10, 40, 7)]
