import json
import struct

import pytest

from vialens.sources import feeds, minutes, schedule_files, tiles


def varint(v):
    out = b""
    while v > 127:
        out += bytes([v & 127 | 128])
        v >>= 7
    return out + bytes([v])


def field(n, kind, value):
    return varint(n << 3 | kind) + (varint(len(value)) + value if kind == 2 else varint(value) if kind == 0 else value)


def message():
    position = b"".join(field(k, 5, struct.pack("<f", v)) for k, v in ((1, -22.9), (2, -43.4), (3, 90.0), (5, 7.5)))
    vehicle = field(1, 2, field(1, 2, b"t1") + field(5, 2, b"10") + field(6, 0, 1)) + field(2, 2, position) + field(5, 0, 1800000000) + field(8, 2, field(2, 2, b"901")) + field(77, 0, 5)
    return field(1, 2, field(1, 2, b"2.0")) + field(2, 2, field(1, 2, b"e") + field(4, 2, vehicle))


def test_positions(spark):
    f = feeds.decode_positions(message(), 5)[0]
    assert (f["vehicle"], f["t"], f["dir"], f["trip_id"], f["service"], f["brt"]) == ("901", 1800000000, "volta", "t1", "10", True)
    assert f["lat"] == pytest.approx(-22.9, abs=1e-5) and f["heading"] == 90
    for k in range(len(message())):
        feeds.decode_positions(message()[:k], 5)
    df = spark.createDataFrame([(message(), 5), (b"\xff\xff", 5)], "content binary, received long")
    assert feeds.fixes_of_messages(df).count() == 1


def test_pages(spark):
    rows = [
        {"id_veiculo": "A1", "fornecedor": "Conecta", "modo": "onibus", "servico": "474", "sentido": "I", "latitude": -22.9, "longitude": -43.4, "direcao": 90.0, "datetime": "2027-01-15T08:00:00Z", "extra": 1},
        {"id_veiculo": "A2", "fornecedor": "sonda", "modo": "brt", "servico": " ", "latitude": -22.9, "longitude": -43.4, "direcao": None, "datetime": "2027-01-15T05:00:00-03:00"},
        {"id_veiculo": " ", "latitude": -22.9, "longitude": -43.4, "datetime": "2027-01-15T08:00:00Z"},
        {"id_veiculo": "A3", "latitude": None, "longitude": -43.4, "datetime": "2027-01-15T08:00:00Z"},
    ]
    body = json.dumps({"data": rows, "providers_status": {"conecta": "ok", "x": 3}})
    got = feeds.fixes_of_pages(spark.createDataFrame([(body,), ("{not json",)], "value string")).orderBy("vehicle").collect()
    assert [r["vehicle"] for r in got] == ["A1", "A2"] and got[0]["t"] == got[1]["t"] and got[1]["service"] is None and got[1]["brt"]
    status = feeds.provider_status(spark.createDataFrame([(1, body), (2, json.dumps({"providers_status": {"x": "down"}}))], "page int, value string")).collect()
    assert {r["provider"]: r["status"] for r in status} == {"conecta": "ok", "x": "down"}


def test_csv(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿id,name\n1,\"a, b\"\n2,\"say \"\"hi\"\"\"\n\n3,\"São\nJoão\"\n4,x\n".encode())
    got = schedule_files.read_csv(spark, str(tmp_path / "a.txt"), ["id", "name", "more"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", "a, b", ""), ("2", 'say "hi"', ""), ("3", "São\nJoão", ""), ("4", "x", "")]


#: A rectangle: a move, three lines and a close.
RING = [9, 2, 10, 26, 12, 0, 0, 8, 11, 0, 15]


def layer():
    feature = field(2, 2, varint(0) + varint(0) + varint(1) + varint(1)) + field(3, 0, 3) + field(4, 2, bytes(RING))
    return field(3, 2, field(1, 2, b"water") + field(2, 2, feature) + field(3, 2, b"kind") + field(3, 2, b"n") + field(4, 2, field(1, 2, b"lake")) + field(4, 2, field(6, 0, 3)) + field(5, 0, 4096))


def test_tiles():
    assert tiles.geometry(RING) == [[(1, 5), (7, 5), (7, 9), (1, 9)]]
    assert tiles.geometry([9, 2, 2, 10, 4, 0, 15, 10, 0, 2, 9, 1]) == [[(1, 1), (3, 1)], [(3, 2)]]
    (f,) = tiles.features(layer())
    assert f["layer"] == "water" and f["props"] == {"kind": "lake", "n": "-2"} and len(f["parts"][0]) == 4
    assert tiles.inflate(b"x", 0) == tiles.inflate(b"x", 1) == b"x"
    with pytest.raises(ValueError):
        tiles.inflate(b"", 3)


def test_minutes(spark, tmp_path):
    folder = str(tmp_path)
    minutes.land(folder, "2027-01-15T08:00", 0, {"data": []}, last=False)
    r = minutes.MinuteReader({"path": folder})
    rows, end = r.read(r.initialOffset())
    assert not list(rows) and end == r.initialOffset()
    minutes.land(folder, "2027-01-15T08:00", 1, {"data": []}, last=True)
    rows, end = r.read(r.initialOffset())
    assert [x[:2] for x in rows] == [("2027-01-15T08:00", 0), ("2027-01-15T08:00", 1)] and end == {"minute": "2027-01-15T08:00"}
    for k in range(1, 5):
        minutes.land(folder, f"2027-01-15T08:0{k}", 0, {}, last=k == 4)
    assert len(list(r.read(end)[0])) == 1
