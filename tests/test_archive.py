"""Tile archives as rows, and the map built from them, against plain versions of both."""

import gzip
import json
import math
import os
import random
import struct

import pytest
from test_sources import field, varint

from vialens import constants as C
from vialens.functions import basemap as rules
from vialens.operators import basemap
from vialens.sources import archive, files, tiles
from vialens.streaming.keyed import KeyedTable


def tile_number(z, x, y):
    """The inverse of the curve, from the definition: quadrants in the order of entry, each turned as the curve enters it."""
    t = 0
    for k in range(z - 1, -1, -1):
        s = 1 << k
        rx, ry = int(x & s > 0), int(y & s > 0)
        t += s * s * (3 * rx ^ ry)
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
    return sum(4**k for k in range(z)) + t


def test_numbers_of_tiles():
    rng = random.Random(2)
    want = [(z, rng.randrange(1 << z), rng.randrange(1 << z)) for z in (0, 1, 2, 5, 11, 13, 15, 22, 26) for _ in range(40)]
    z, x, y = tiles.zxy([tile_number(*t) for t in want])
    assert list(zip(z.tolist(), x.tolist(), y.tolist(), strict=True)) == want


def zigzag(v):
    return v << 1 if v >= 0 else (-v << 1) - 1


def commands(parts, closed):
    out, at = [], (0, 0)
    for p in parts:
        steps = []
        for q in p:
            steps += [zigzag(q[0] - at[0]), zigzag(q[1] - at[1])]
            at = q
        out += [9, *steps[:2]] + ([len(p) - 1 << 3 | 2, *steps[2:]] if len(p) > 1 else []) + ([15] if closed else [])
    return b"".join(map(varint, out))


def vector_tile(layers):
    """``layers``: name to (extent, [(geometry type, props, parts)])."""
    body = b""
    for name, (extent, found) in layers.items():
        keys = sorted({k for _, props, _ in found for k in props})
        values = sorted({v for _, props, _ in found for v in props.values()})
        out = field(1, 2, name.encode())
        for kind, props, parts in found:
            tags = b"".join(varint(keys.index(k)) + varint(values.index(v)) for k, v in props.items())
            out += field(2, 2, field(2, 2, tags) + field(3, 0, kind) + field(4, 2, commands(parts, kind == 3)))
        out += b"".join(field(3, 2, k.encode()) for k in keys) + b"".join(field(4, 2, field(1, 2, v.encode())) for v in values) + field(5, 0, extent)
        body += field(3, 2, out)
    return body


def directory_bytes(entries):
    ids, last, end = [], 0, None
    for e in entries:
        ids.append(e[0] - last)
        last = e[0]
    offsets = []
    for _, _, at, n in entries:
        offsets.append(0 if at == end else at + 1)
        end = at + n
    return gzip.compress(b"".join(map(varint, [len(entries), *ids, *(e[1] for e in entries), *(e[3] for e in entries), *offsets])))


def write_archive(path, runs, leaf_of=None):
    """``runs``: (first tile id, run, tile bytes). With ``leaf_of``, so many entries a leaf directory, and leaves of leaves."""
    blobs, at, entries = b"", {}, []
    for tile_id, run, content in sorted(runs):
        if content not in at:
            packed = gzip.compress(content)
            at[content] = (len(blobs), len(packed))
            blobs += packed
        entries.append((tile_id, run, *at[content]))
    leaves = b""
    while leaf_of and len(entries) > leaf_of:
        upper = []
        for k in range(0, len(entries), leaf_of):
            d = directory_bytes(entries[k : k + leaf_of])
            upper.append((entries[k][0], 0, len(leaves), len(d)))
            leaves += d
        entries = upper
    root = directory_bytes(entries)
    head = b"PMTiles\x03" + struct.pack("<8Q", 127, len(root), 0, 0, 127 + len(root), len(leaves), 127 + len(root) + len(leaves), len(blobs)) + bytes(24) + b"\x01\x02\x02\x01" + bytes(27)
    with open(path, "wb") as f:
        f.write(head + root + leaves + blobs)


@pytest.mark.parametrize("leaf_of", [None, 3])
def test_archive_as_rows(spark, tmp_path, leaf_of, monkeypatch):
    monkeypatch.setattr(archive, "READ", 300)
    rng = random.Random(5)
    want, archives = {}, []
    for k in range(2):
        runs, tile_id = [], 0
        for _ in range(40):
            tile_id += rng.randrange(1, 4)
            run = rng.choice([1, 1, 1, 3])
            content = vector_tile({"water": (4096, [(3, {"kind": f"lake {rng.randrange(12)}"}, [[(0, 0), (9, 0), (9, 9)]])])})
            runs.append((tile_id, run, content))
            want |= {(f"{tmp_path}/a{k}", t): content for t in range(tile_id, tile_id + run)}
            tile_id += run
        write_archive(f"{tmp_path}/a{k}", runs, leaf_of)
        archives.append((f"{tmp_path}/a{k}",))
    index = archive.entries(spark.createDataFrame(archives, "path string"))
    rows = archive.wanted(index)
    assert {(r["path"], r["tile_id"]) for r in rows.collect()} == set(want)
    for path, in archives:
        got = archive.read_tiles(rows.where(rows.path == path)).collect()
        assert {r["tile_id"]: bytes(r["content"]) for r in got} == {t: c for (p, t), c in want.items() if p == path}
    plain = {tuple(int(v[0]) for v in tiles.zxy([t])) for _, t in want}
    assert {(r["z"], r["x"], r["y"]) for r in rows.collect()} == plain
    f = archive.archive_features(spark.createDataFrame(archives[:1], "path string"))
    assert f.count() == len([1 for p, _ in want if p == archives[0][0]]) and all(r["props"]["kind"].startswith("lake") for r in f.select("props").collect())


def test_not_an_archive(spark, tmp_path):
    for name, body in (("short", b"PMTiles\x03"), ("other", bytes(200))):
        (tmp_path / name).write_bytes(body)
        with pytest.raises(Exception, match="ends before|not a version 3"):
            archive.entries(spark.createDataFrame([(f"{tmp_path}/{name}",)], "path string")).collect()


def half_away(v):
    return int(math.copysign(math.floor(abs(v) + 0.5), v))


def plain_simplify(p, tol):
    if len(p) < 3:
        return p
    (ax, ay), (bx, by) = p[0], p[-1]
    size = max(math.hypot(bx - ax, by - ay), 1e-9)
    d = [abs((x - ax) * (by - ay) - (y - ay) * (bx - ax)) / size for x, y in p[1:-1]]
    k = d.index(max(d)) + 1
    return plain_simplify(p[: k + 1], tol)[:-1] + plain_simplify(p[k:], tol) if d[k - 1] > tol else [p[0], p[-1]]


def plain_path(p):
    out = []
    for x, y in p:
        q = [half_away(x), half_away(y)]
        if out[-2:] != q:
            out += q
    return out


def plain_map(held):
    """Of ``(z, x, y) -> layers`` the documents of the map."""
    docs, places = {}, []
    for (z, x, y), layers in sorted(held.items(), key=lambda i: tile_number(*i[0])):
        t = {k: [] for k in ("w", "g", "s", "r0", "r1", "r2", "l")}
        for name, (extent, found) in layers.items():
            for geometry, props, parts in found:
                kind, scaled = props.get("kind", ""), [[(a * 1024 / extent, b * 1024 / extent) for a, b in p] for p in parts]
                if geometry == 3 and (name == "water" and kind not in rules.NO_WATER or name in ("landuse", "landcover") and kind in [*rules.GREEN, *rules.SAND]):
                    to, least = ("w", 20) if name == "water" else ("g", 120 if z >= 15 else 60) if kind in rules.GREEN else ("s", 40)
                    rings, outer = [], False
                    for p in scaled:
                        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2
                        outer = area >= least if area > 0 else outer
                        flat = plain_path(plain_simplify(p, 2.0 if z >= 15 else 1.4))
                        if outer and abs(area) >= least and len(flat) >= 6:
                            rings.append(flat)
                    t[to] += [rings] if rings else []
                elif name == "roads" and geometry == 2 and kind in ("highway", "major_road", "medium_road", "minor_road") and (kind != "minor_road" or z >= 13):
                    rank, best = {"highway": 0, "minor_road": 2}.get(kind, 1), None
                    for p in scaled:
                        s = plain_simplify(p, 1.4)
                        flat = plain_path(s)
                        if len(flat) < 4:
                            continue
                        t[f"r{rank}"].append(flat)
                        for a, b in zip(s, s[1:], strict=False):
                            d = math.hypot(b[0] - a[0], b[1] - a[1])
                            if best is None or d > best[0]:
                                best = (d, a, b)
                    if z == 15 and rank < 2 and "name" in props and best and best[0] > 90:
                        _, a, b = best
                        mx, my, angle = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2, math.degrees(math.atan2(b[1] - a[1], b[0] - a[0]))
                        if 0 <= mx < 1024 and 0 <= my < 1024 and props["name"] not in [e[3] for e in t["l"]]:
                            t["l"].append([half_away(mx), half_away(my), half_away(angle - 180 if angle > 90 else angle + 180 if angle < -90 else angle), props["name"], rank])
                elif name == "places" and geometry == 1 and kind in rules.PLACES and "name" in props:
                    wx, wy = (x + parts[0][0][0] / extent) / 2**z, (y + parts[0][0][1] / extent) / 2**z
                    places.append((rules.PLACES[kind], props["name"], wx * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * wy))))))
        t["l"].sort(key=lambda e: e[3])
        if any(v for k, v in t.items() if k != "l"):
            docs[f"{z}/{x}/{y}.json"] = {k: v for k, v in t.items() if v}
    kept = []
    for rank, name, lon, lat in sorted((p for p in places if C.AREA_LAT[0] <= p[3] <= C.AREA_LAT[1] and C.AREA_LON[0] <= p[2] <= C.AREA_LON[1]), key=lambda p: p[:2]):
        if all(k[2] != name or math.hypot((k[0] - lon) * C.M_PER_LON, (k[1] - lat) * C.M_PER_LAT) >= 1000 for k in kept):
            kept.append([lon, lat, name, rank])
    docs["places.json"] = [[round(lon, 5), round(lat, 5), n, r] for lon, lat, n, r in kept]
    return docs


@pytest.fixture(scope="module")
def city(tmp_path_factory):
    """A city of random water, green, sand, roads and places at all zooms, some tiles outside or of other zooms, some with nothing drawn."""
    rng = random.Random(11)
    extent, held = 4096, {}
    wander = lambda n, step: [(x := rng.randrange(extent), y := rng.randrange(extent))] + [(x := x + rng.randrange(-step, step), y := y + rng.randrange(-step, step)) for _ in range(n)]
    kinds = {"water": ["lake", "fountain", "sea"], "landuse": ["park", "beach", "industrial"], "landcover": ["meadow", "sand"], "roads": ["highway", "major_road", "medium_road", "minor_road", "path"], "places": ["locality", "macrohood", "suburb", "city"]}
    spots = [(11, 775, 1157), (11, 776, 1158), (13, 3107, 4634), (13, 3108, 4635), (15, 12430, 18540), (15, 12431, 18541), (15, 12432, 18541), (15, 12433, 18541), (12, 1550, 2316), (13, 0, 0), (15, 12440, 18550)]
    for z, x, y in spots:
        layers = {}
        for name, of in kinds.items():
            found = []
            for _ in range(rng.randrange(3, 9)):
                props = {"kind": rng.choice(of)} | ({"name": rng.choice(["Rua A", "Rua \"B\"", "Praça Ç", "Centro"])} if rng.random() < 0.8 else {})
                if name == "roads":
                    found.append((2, props, [wander(rng.randrange(1, 12), 900) for _ in range(rng.randrange(1, 3))]))
                elif name == "places":
                    found.append((1, props, [[(rng.randrange(extent), rng.randrange(extent))]]))
                else:
                    cx, cy, size = rng.randrange(extent), rng.randrange(extent), rng.choice([8, 60, 500])
                    round_ = lambda s, n: [(cx + int(s * math.cos(6.28 * k / n) + rng.random()), cy + int(s * math.sin(6.28 * k / n))) for k in range(n)]
                    found.append((3, props, [round_(size, rng.randrange(3, 20)), round_(size / 3, 7)[::-1]]))
            layers[name] = (extent, found)
        held[z, x, y] = layers
    held[15, 12440, 18550] = {"places": held[15, 12440, 18550]["places"], "landuse": (extent, [(3, {"kind": "industrial"}, [[(0, 0), (900, 0), (900, 900)]])])}
    path = f"{tmp_path_factory.mktemp('city')}/city.archive"
    write_archive(path, [(tile_number(*k), 1, vector_tile(v)) for k, v in held.items()], leaf_of=2)
    return path, held


def test_map_against_a_plain_one(spark, city, tmp_path):
    path, held = city
    inside = lambda z, x, y: z in rules.ZOOMS and (z, x, y) not in [(13, 0, 0)]
    want = plain_map({k: v for k, v in held.items() if inside(*k)})
    features = archive.archive_features(spark.createDataFrame([(path,)], "path string"), rules.ZOOMS)
    docs = basemap.map_documents(features)
    table = KeyedTable(spark, f"file://{tmp_path}/published", ["path"], "path string, digest string, size long")
    stats = files.write_documents(docs, f"file://{tmp_path}/map", table, 0, level=9)
    assert stats["files"] == len(want) and sum("l" in t for t in want.values() if isinstance(t, dict)) > 0 and len(want["places.json"]) > 3
    for name, body in want.items():
        with open(f"{tmp_path}/map/{name}", encoding="utf-8") as f:
            got = json.load(f)
        if name == "places.json":
            got, body = ([[round(v, 4) if isinstance(v, float) else v for v in p] for p in b] for b in (got, body))
        assert got == body, name
    assert "15/12440/18550.json" not in want and not os.path.exists(f"{tmp_path}/map/15/12440/18550.json")
    basemap.save_tiles(basemap.map_tiles(features), str(tmp_path / "tiles"))
    back = spark.read.parquet(str(tmp_path / "tiles"))
    assert sorted(f"{r['z']}/{r['x']}/{r['y']}.json" for r in back.collect()) == sorted(set(want) - {"places.json"})


def test_bounds_prune_what_is_read(spark, city):
    path, held = city
    rows = archive.wanted(archive.entries(spark.createDataFrame([(path,)], "path string")), rules.ZOOMS).collect()
    assert {(r["z"], r["x"], r["y"]) for r in rows} == {k for k in held if k[0] in rules.ZOOMS and k != (13, 0, 0)}


def test_simplified_by_the_line_through_the_ends(spark):
    """A point beyond the ends of the chord but near its line goes; a long line keeps its corners."""
    from pyspark.sql import functions as F

    from vialens.functions import folds

    rng = random.Random(8)
    lines = [[(0, 0), (14.5, 0.75), (7, 0)], [(3, 3)], [(3, 3), (3, 3)], [(0, 0), (2, 9), (0, 0)]] + [[(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(rng.randrange(2, 40))] for _ in range(40)]
    df = spark.createDataFrame([(k, [float(v) for q in p for v in q]) for k, p in enumerate(lines)], "k int, p array<double>")
    for tol in (1.0, 12.5):
        got = df.select("k", folds.simplified("p", F.lit(tol)).alias("s"), folds.quantised("p").alias("q")).collect()
        assert all(list(zip(r["s"][::2], r["s"][1::2], strict=True)) == [tuple(map(float, q)) for q in plain_simplify(lines[r["k"]], tol)] for r in got)
        assert all(r["q"] == plain_path(lines[r["k"]]) for r in got)
