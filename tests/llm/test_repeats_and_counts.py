"""The filter audit, byte repeats and collocations against plain versions."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from compare import same_rows
from pyspark.sql import functions as F

from vialens.llm import audit, byte_repeats, collocations, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_collocations"])
def test_same_rows_as_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), SF, queries.ORACLES[name])


def plain_mask(rows, i):
    doc, text = rows[i][0], rows[i][1] or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = (len(ws) < 100) + 2 * (100 * len(set(ws)) < 80 * len(ws)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + 8 * bool(re.search(r"[#$%&*|]", text))
    return out + 16 * (doc is not None and any((r[1] or "") == text and r[0] is not None and r[0] < doc for r in rows))


def test_masks(spark, corpus):
    df, raw = corpus
    want = collections.Counter((r[0], r[2] or "", plain_mask(raw, i)) for i, r in enumerate(raw))
    got = audit.failure_masks(df.repartition(7)).collect()
    assert collections.Counter((r["doc_id"], r["part"], r["mask"]) for r in got) == want


@pytest.mark.parametrize("collide", [False, True])
def test_copies_that_fill_several_ranges(spark, monkeypatch, collide):
    """Most rows are one text, more than a range holds; with ``collide`` all texts have one fingerprint."""
    if collide:
        monkeypatch.setattr(audit.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    rng = random.Random(3)
    raw = [(k, "hot copy" if k % 3 else f"text {rng.randrange(12)}", "en") for k in range(400)] + [(5, "hot copy", "de"), (5, "hot copy", None), (None, "hot copy", "en"), (1, "hot copy", "en"), (1, "hot copy", "en")]
    rng.shuffle(raw)
    want = collections.Counter((r[0], r[2] or "", plain_mask(raw, i)) for i, r in enumerate(raw))
    got = audit.failure_masks(spark.createDataFrame(raw, DOCS)).collect()
    assert collections.Counter((r["doc_id"], r["part"], r["mask"]) for r in got) == want


def test_audit_in_every_order(spark):
    masks = [("en", 0), ("en", 3), ("en", 1), ("en", 31), ("de", 16), ("en", 3), ("", 20)]
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (3, 0, 1), (4, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame([(i, p, m) for i, (p, m) in enumerate(masks)], "doc_id long, part string, mask int")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in audit.audit(audit.counters(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    assert len(got) == 3 * 120 * 5
    good, toxic = {0, 1, 4}, {1, 3}
    shapley = collections.Counter()
    for part in ("en", "de", ""):
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [i for i, (p, _) in enumerate(masks) if p == part]
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                out = [i for i in left if masks[i][1] & bit]
                fails = [i for i, (p, m) in enumerate(masks) if p == part and m & bit]
                r = got[part, order, step]
                left = [i for i in left if i not in out]
                assert (r["kept"], r["removed"], r["redundant"]) == (len(left), len(out), len(fails) - len(out))
                assert r["unique_fails"] == sum(masks[i][1] == bit for i in fails)
                assert (r["good_lost"], r["toxic_lost"]) == (len(good & set(out)), len(toxic & set(out)))
                shapley[part, letter] += len(out)
    assert all(r["shapley"] == shapley[p, o[s - 1]] for (p, o, s), r in got.items())


def plain_removal(texts, window):
    bodies = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + window] for b in bodies for i in range(len(b) - window + 1))
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        yield len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), kept


def same_removal(df, raw, window, **more):
    want = collections.Counter((r[0], *x) for r, x in zip(raw, plain_removal([r[1] for r in raw], window), strict=True))
    got = byte_repeats.remove_repeats(df, window, **more).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want
    return want


def test_byte_repeats(corpus):
    df, raw = corpus
    want = same_removal(df, raw, 400)
    assert any(0 < r[2] < r[1] for r in want) and any(r[2] == 0 for r in want)


@pytest.mark.parametrize(("window", "gram", "crowd", "chunk"), [(400, 64, 50_000, 20_000), (40, 8, 50_000, 3), (40, 8, 3, 10), (40, 16, 1, 1)])
def test_byte_repeats_at_random(spark, monkeypatch, window, gram, crowd, chunk):
    """Periods, single letters, passages in many surroundings, texts longer than a block; collections split down to windows."""
    monkeypatch.setattr(byte_repeats, "_BLOCK", 1500)
    rng = random.Random(window + gram + crowd)
    letters = lambda n, of="abcdefghij é": "".join(rng.choice(of) for _ in range(n))
    passage = letters(int(window * 1.6))
    raw = [(k, letters(rng.randrange(3 * window)) + passage[: rng.randrange(len(passage))] + letters(rng.randrange(window)), "en") for k in range(60)]
    raw += [(100 + k, letters(30) + passage + letters(30), "en") for k in range(40)]
    raw += [(200, "a" * 5 * window, "en"), (201, "ab" * 3 * window, "en"), (202, letters(9000, "ab"), "en"), (203, passage * 3, "en"), (204, None, None), (205, "", "en"), (206, passage[:window], "en"), (None, passage, "en")]
    raw += [(100, raw[60][1], "en"), (100, raw[60][1], "en"), (300, raw[0][1] + "x" + raw[1][1], "en")]
    same_removal(spark.createDataFrame(raw, DOCS).repartition(5), raw, window, gram=gram, crowd=crowd, chunk=chunk)


def test_columns_are_sorted_suffixes():
    """Each round's neighbours and common prefixes, by the verdicts that they give, against all pairs of pieces."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        m, window = int(rng.integers(1, 25)), 6
        texts = [bytes(rng.integers(97, 99, rng.integers(6, 14)).astype(np.uint8)) for _ in range(m)]
        back = np.asarray([rng.integers(0, len(t)) for t in texts])
        group = np.sort(rng.integers(0, 3, m))
        copies = rng.integers(1, 3, m)
        least, most = byte_repeats.build(group, texts, back, copies, window)
        for i, t in enumerate(texts):
            same = [s for s in range(len(t) - window + 1) if copies[i] > 1 or any(j != i and group[j] == group[i] and 0 <= s - back[i] + back[j] and texts[j][s - back[i] + back[j] :][:window] == t[s : s + window] for j in range(m))]
            assert (least[i], most[i]) == ((min(same), max(same)) if same else (-1, -1))


def test_byte_repeats_query(spark):
    docs = queries.table(spark, SF, "documents").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in queries.op12_byte_repeats(spark, SF).collect()}
    assert len(got) == len(docs)
    for r, (n, gone, runs, kept) in zip(docs, plain_removal([r["text"] for r in docs], 400), strict=True):
        x = got[r["doc_id"]]
        assert (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) == (n, gone, runs, hashlib.sha256(kept).hexdigest())


def plain_collocations(rows, least, top, most=5):
    f, total = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(ws)
            f.update((lang or "und", *ws[i : i + k]) for k in range(1, most + 1) for i in range(len(ws) - k + 1))
    can = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = collections.defaultdict(list)
    for p, a in can.items():
        lang, ws = p[0], p[1:]
        if any(q[0] == lang and len(q) > len(p) and x >= a and any(q[i : i + len(ws)] == ws for i in range(1, len(q))) for q, x in can.items()):
            continue
        n = total[lang]
        score, _, le, r = min((1000 * a * n // (f[lang, *ws[:k]] * f[lang, *ws[k:]]), k, f[lang, *ws[:k]], f[lang, *ws[k:]]) for k in range(1, len(ws)))
        out[lang].append((-score, -a, " ".join(ws).encode(), le, r, n))
    return {(lang, i, p.decode(), -a, le, r, n, -s) for lang, rs in out.items() for i, (s, a, p, le, r, n) in enumerate(sorted(rs)[:top], 1)}


@pytest.mark.parametrize(("least", "top", "small"), [(3, 2000, False), (4, 9, True), (1, 2000, False), (10_000, 5, False)])
def test_collocations(spark, corpus, monkeypatch, least, top, small):
    if small:  # texts are summed a few at a time, words begun anew
        monkeypatch.setattr(collocations, "_TEXT_BYTES", 500)
        monkeypatch.setattr(collocations, "_KEPT_WORDS", 50)
    df, raw = corpus
    rng = random.Random(9)
    more = [(500 + k, " ".join(rng.choice("a B c dé x\x1cy,z q. r\tS\x0b".split(" ")) for _ in range(40)), rng.choice(["en", "de", None, ""])) for k in range(60)]
    more = [r if r[2] != "" else (*r[:2], "und") for r in more]
    rows = [r[:3] for r in raw] + more
    if least == 1:
        rows = more[:8]
    got = collocations.collocations(spark.createDataFrame(rows, DOCS), least, 5, top).collect()
    want = plain_collocations(rows, least, top)
    assert {tuple(r) for r in got} == want and len(got) == len(want) and (want or least > 1000)


def test_products_past_64_bits(spark, monkeypatch):
    """Counts of a huge corpus: the product is exact and its floor fits a long."""
    big = 9_000_000_000_000
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 7)], "lang string, phrase string, words int, f long")
    total = spark.createDataFrame([("en", 4 * big + 3)], "lang string, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: (counts, total))
    (r,) = collocations.collocations(counts).collect()
    assert r["score"] == 1000 * (big - 7) * (4 * big + 3) // (big * (big - 1))


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert audit.filter_audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert byte_repeats.remove_repeats(none).count() == 0
    assert collocations.collocations(none).count() == 0
