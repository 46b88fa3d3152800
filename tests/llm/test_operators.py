"""Each operator against a plain version, on rows with every odd case, and on an empty table."""

import collections
import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from vialens.llm import html_text, lines, media, mixing, packing, quality, queries, sharding, simhash, substrings, token_output
from vialens.llm.common import fresh_path, ordered_prefix, prefix_by_key, row_key
from vialens.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# 1. packing


def check_bins(rows, out, capacity):
    bins, texts = collections.defaultdict(list), collections.defaultdict(list)
    for i, t, _, s in rows:
        texts[i].append(len(words(t)))
    for r in out:
        bins[r["bin"]].append(r)
    for b in bins.values():
        assert sum(r["n_words"] for r in b) == b[0]["bin_words"] <= capacity
        held = [r["source"] for r in b]
        assert len(held) == len(set(held))
    got = collections.defaultdict(int)
    for r in out:
        got[r["doc_id"]] += r["n_words"]
    assert {i: sum(v) for i, v in texts.items()} == dict(got)


@pytest.mark.parametrize("group_rows", [4096, 10])
def test_packing(corpus, group_rows):
    df, rows = corpus
    out = packing.pack(df, 256, group_rows).collect()
    check_bins(rows, out, 256)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, packing.pack(df.repartition(5), 256, group_rows).collect()), key=str)


def test_packing_keeps_clusters_apart(spark):
    rows = [(i, "w " * (5 + i % 7), f"s{i % 9}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clusters = spark.createDataFrame([(i, i % 11) for i in range(100)], "doc_id long, cluster long")
    held = collections.defaultdict(list)
    out = packing.pack(df, 64, clusters=clusters).collect()
    for r in out:
        if r["doc_id"] < 100:
            held[r["bin"]].append(r["doc_id"] % 11)
    assert len(out) == 120 and all(len(x) == len(set(x)) for x in held.values())


def test_copies_without_an_id_are_in_their_twins_cluster(spark):
    df = spark.createDataFrame([(1, "t u v", "a"), (None, "t u v", "b"), (2, "t u w", "c"), (None, "z", "d")], "doc_id long, text string, source string")
    clusters = spark.createDataFrame([(1, 7), (2, 7)], "doc_id long, cluster long")
    bins = [(r["source"], r["bin"]) for r in packing.pack(df, clusters=clusters).collect()]
    assert len({b for s, b in bins if s in "abc"}) == 3


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(3)
    items = [(rng.randrange(0, 60), rng.randrange(5), rng.randrange(8)) for _ in range(300)]
    bins = packing.best_fit([i[0] for i in items], [i[1] for i in items], [i[2] for i in items], 100)
    left, sources, clusters = {}, collections.defaultdict(set), collections.defaultdict(set)
    for (size, s, c), b in zip(items, bins, strict=True):
        fits = [x for x in left if left[x] >= size and left[x] > 0 and s not in sources[x] and c not in clusters[x]]
        if fits:
            assert left[b] == min(left[x] for x in fits) and b in fits
        else:
            assert b not in left
        left[b] = left.get(b, 100) - size
        sources[b].add(s)
        clusters[b].add(c)


def test_packing_cuts_long_documents(spark):
    df = spark.createDataFrame([(1, "a " * 25, "s"), (2, "b " * 3, "t")], "doc_id long, text string, source string")
    out = packing.pack(df, 10).orderBy("doc_id", "piece").collect()
    assert [(r["start_word"], r["n_words"]) for r in out if r["doc_id"] == 1] == [(0, 10), (10, 10), (20, 5)] and out[2]["bin"] == out[3]["bin"]


# 2. token files


def test_tokens(spark, corpus):
    from tokenizers import Tokenizer

    df, rows = corpus
    path, file = fresh_path(spark, "t"), public_tokenizers.path("word_bpe_49k.json")
    token_output.write_tokens(df, path, file, end_id=2)
    got = token_output.token_digests(token_output.read_tokens(spark, path)).orderBy("start").collect()
    t = Tokenizer.from_file(file)
    ids = {(i, x): [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x, _, _ in rows}
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = collections.Counter((i, len(v), zlib.crc32(np.asarray(v, "<u4").tobytes())) for (i, x), v in ((r[:2], ids[r[:2]]) for r in rows))
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert token_output.lookup_tokens(spark, path, [133]).first()["ids"] == ids[(133, "one")]


def test_tokens_of_words_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(file)
    docs = [r for r in pd.read_parquet("/root/testdata/sf0.001/documents.parquet")["text"]] + ["don't we'LL 123 <|endoftext|> á ́b ΑΣ ΑΣ x 5% ​ \x00 \x1f  z 漢字かな", ""]
    got = token_output.encode_texts(docs, file)
    assert got == [np.asarray(t.encode(d, add_special_tokens=False).ids, "<i4").tobytes() for d in docs]


# 3. mixing


def targets(sizes, weights=(1, 2, 3)):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(3 * sizes[s] for s in full)
        new = {s for s in free if rest * w[s] / sum(w[x] for x in free) > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in free) for s in order}
        full |= new


def test_mixing(corpus):
    df, rows = corpus
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and collections.Counter(r["doc_id"] for r in out) == collections.Counter(r[0] for r in rows)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in out:
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = targets(sizes)
    for s, t in want.items():
        assert next(r["target"] for r in out if r["source"] == s) == pytest.approx(t)
        biggest = sorted(r["size"] for r in out if r["source"] == s)[-2]
        assert abs(taken[s] - t) <= biggest
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["row_key"], r["copies"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    mixed = mixing.apply_mix(df)
    assert mixed.columns == df.columns
    got = collections.Counter()
    for r in mixed.select("source", "text").collect():
        got[r["source"]] += len(words(r["text"]))
    for s, t in want.items():
        assert abs(got[s] - t) <= sorted(r["size"] for r in out if r["source"] == s)[-2]


def test_mixing_tilts_by_size(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, "w " * rng.randrange(5, 60), f"s{i % 4}") for i in range(1200)], "doc_id long, text string, source string")
    out = mixing.mix(df).toPandas()
    g = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((g.taken - g.target).abs() / g.target).max() < 0.002
    low = out[out.source == "s0"]
    assert low[low["size"] < 15].copies.mean() > low[low["size"] > 45].copies.mean()


def test_dual_has_its_gradient_and_settles(spark):
    """The derivatives summed are those of the dual by finite differences, and the solution is that of bisection on the gradient."""
    z, n = np.asarray([0.1, 0.5, 1.0, 2.5, 9.0]), np.asarray([4.0, 3.0, 7.0, 2.0, 1.0])
    phi = lambda u: np.where(u < np.log(3), np.exp(np.minimum(u, 2)), 3 * (1 + u - np.log(3)))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(z, n, strict=True)], "z double, n double")
    for lam in (-1.3, 0.0, 0.2, 0.9):
        got = df.agg(*mixing.dual_at(F.lit(lam), F.col("z"), F.col("n"))).first()
        value = lambda x: float((n * phi(x * z)).sum())
        assert got[0] == pytest.approx(value(lam))
        assert got[1] == pytest.approx((value(lam + 1e-6) - value(lam - 1e-6)) / 2e-6, rel=1e-5)
        assert got[2] == pytest.approx((value(lam + 1e-4) - 2 * value(lam) + value(lam - 1e-4)) / 1e-8, rel=1e-3)
    cells = spark.createDataFrame([(s, int(a * 100), int(b)) for s in ("a", "b", None) for a, b in zip(z, n, strict=True)], "source string, size long, n long")
    words, docs = int((z * 100 * n).sum()), int(n.sum())
    share = {"a": 0.05, "b": 2.9, None: 1.2}
    sources = spark.createDataFrame([(s, words, docs, words * x) for s, x in share.items()], "source string, words long, docs long, target double")
    for r in mixing.balance(cells, sources).collect():
        taken = lambda lam: float((n * z * 100 * np.exp(np.minimum(lam * z * 100 * docs / words, np.log(3)))).sum())
        low, high = -200.0, 200.0
        for _ in range(200):
            low, high = ((low + high) / 2, high) if taken((low + high) / 2) < words * share[r["source"]] else (low, (low + high) / 2)
        assert r["lam"] == pytest.approx(low, abs=1e-4) and taken(r["lam"]) == pytest.approx(words * share[r["source"]], rel=1e-5)


def test_rows_that_differ_in_one_more_column_are_mixed_apart(spark):
    df = spark.createDataFrame([(1, "a b c d", "s0", k) for k in range(30)] + [(2, "e f g h i", "s1", 0)] * 9, "doc_id long, text string, source string, tag int")
    got = mixing.apply_mix(df)
    assert got.count() == sum(r["copies"] for r in mixing.mix(df, key=row_key(df.columns)).collect())
    assert got.where("doc_id = 1").select("tag").distinct().count() > 10


# 4. substrings


def cut_plain(rows, n=35):
    count = collections.Counter(tuple(w[k : k + n]) for w in (words(r[1]) for r in rows) for k in range(len(w) - n + 1))
    out = collections.Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if count[tuple(w[k : k + n])] > 1:
                gone[k : k + n] = [True] * n
        out[i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [100_000, 2])
def test_substrings(corpus, hot):
    df, rows = corpus
    got = substrings.remove_repeats(df, hot=hot).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert collections.Counter(map(tuple, got)) == cut_plain(rows)


def test_substrings_at_random(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 120)))) for i in range(40)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert collections.Counter(map(tuple, got)) == cut_plain(rows)


# 5. html

PAGES = [
    ("<html><body><nav><a href=1>Home</a></nav><article><h1>Title &amp; more</h1><p>One <b>two</b>\n three</p><aside>no</aside><p>x</p><div class='comments'><p>reader says a lot of things here</p></div></article><footer>f</footer>", "Title & more\nOne two three\nx"),
    ("<div id='main-content'><p>plain text without an article but with enough words to be a paragraph of the page, surely</p></div>", None),
    ("<article><p>cut off in a tag <b>here</b> <a href=\"/x", "cut off in a tag here"),
    ("<article>a<script>var t='</p>';</script><style>p{}</style><!-- c > --><p title='a>b'>b&lt;c &#233; &nbsp; d</p><form>q</form><br>e</article>", "a\nb<c é d\ne"),
    ("", ""),
    (None, ""),
    ("just text", ""),
    ("<article><ul><li>one<li>two</ul><header>own head</header></article><header>page head</header>", "one\ntwo\nown head"),
]


def test_html(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", h, 1) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    for i, (_, want) in enumerate(PAGES):
        if want is not None:
            assert got[i]["text"] == want
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[1]["text"].startswith("plain text")
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_margins_are_no_wrappers_nor_parts_of_names():
    body = " ".join(f"word{k}" for k in range(60))
    tree = html_text.train_tree(*html_text.labelled_table())

    def main(page):
        found = html_text.blocks(page)
        return [b[0] for b, ok in zip(found, html_text.judge(tree, html_text.block_features(found)), strict=True) if ok]

    for name in ("content has-sidebar", "nav-closed", "sidebar", "search"):
        assert main(f'<div class="{name}"><article><p>{body}</p></article></div>') == [body]
        assert main(f'<div class="{name}"><p>{body}</p><p>{body}</p></div>') == [body, body]
    assert main(f'<article><p>{body}</p><section id="related-work"><p>{body} x</p></section><p class="share-price">{body} y</p></article>') == [body, body + " x", body + " y"]
    assert main(f'<article><p>a <span class="comment">note</span> {body}</p></article>') == [f"a note {body}"]
    for name in ("sidebar", "site-nav", "post-comments", "related"):
        assert main(f'<article><p>{body}</p></article><div class="{name}"><p>{body}</p></div>') == [body]
        assert main(f'<article><p>{body}</p><p>{body}</p><div class="{name}"><p>{body}</p></div></article>') == [body, body]


def test_html_tree_on_held_out_rows():
    x, y = html_text.labelled_table()
    right = [html_text.judge(html_text.train_tree(np.delete(x, k, 0), np.delete(y, k)), x[k : k + 1])[0] == y[k] for k in range(len(x))]
    assert np.mean(right) >= 0.85 and (html_text.judge(html_text.train_tree(x, y), x) == y).all()


# 6. lines


def test_lines_as_sql(spark):
    from compare import same_rows

    sf = "/root/testdata/sf0.001"
    same_rows(queries.op6_line_dedup(spark, sf), sf, queries.ORACLES["op6_line_dedup"])


def test_lines(corpus):
    df, rows = corpus
    out = lines.drop_boilerplate(df, ratio=0.3, least_pages=5)
    assert out.columns == df.columns and out.count() == len(rows)
    pages, total = collections.Counter(), collections.Counter()
    for _, t, _, s in rows:
        total[s] += 1
        pages.update({(s, x.strip(" \t\n\v\f\r")) for x in (t or "").split("\n") if words(x)})
    drop = {k for k, n in pages.items() if n >= 5 and n / total[k[0]] > 0.3}
    assert drop
    want = collections.Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\n\v\f\r")) not in drop)) for i, t, _, s in rows)
    assert collections.Counter((r["doc_id"], r["text"]) for r in out.collect()) == want


# 7. simhash


def fingerprint(t, n=3):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, most=2):
    ids = list(range(len(fps)))
    root = dict(zip(ids, ids, strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= most:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in ids]


def test_simhash(corpus):
    df, rows = corpus
    fps = [fingerprint(r[1]) for r in rows]
    g = groups(fps)
    least = collections.defaultdict(list)
    for r, k in zip(rows, g, strict=True):
        least[k].append(r[0])
    want = collections.Counter((r[0], f"{f:016x}", min((i for i in least[k] if i is not None), default=None)) for r, f, k in zip(rows, fps, g, strict=True))
    out = simhash.near_duplicates(df).select("doc_id", simhash.hex_fingerprint(F.col("fp")), "component_id").collect()
    assert collections.Counter(map(tuple, out)) == want


@pytest.mark.parametrize("hot", [1, 6, 10**9])
@pytest.mark.parametrize("parts", [None, "mixed"])
def test_links_connect_what_is_near(spark, hot, parts):
    rng = random.Random(4)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            fps.add(f)
            for _ in range(rng.randrange(0, 4)):
                f ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    plan = None if parts is None else [simhash.Part(tuple(range(32)), 0), simhash.Part(tuple(range(32, 64)), 1)]
    nodes = {r["node"]: r["root"] for r in components(simhash.links(df, 2, plan, hot)).collect()}
    got = [nodes.get(f, f) for f in signed]
    want = groups(fps)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_plan_keeps_the_pigeonhole(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(300)], "fp long")
    for most in (1, 2, 5):
        parts = simhash.plan_parts(df, most)
        assert sum(p.most + 1 for p in parts) == most + 1 and len({b for p in parts for b in p.bits}) == sum(len(p.bits) for p in parts)


def test_one_of_each_group(corpus):
    df, rows = corpus
    out = simhash.one_of_each_group(df)
    assert out.columns == df.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and not {100, 101, 102, 103, 120, 121, None} & set(ids) and {0, 1, 7, 8, 110, 111, 150} - {150} <= set(ids)
    assert len({130, 131, 132} & set(ids)) == 1


def test_one_of_each_group_against_all_pairs(spark):
    """Copies with words appended, cut, a block replaced and scattered edits, near 0.8 on both sides, and a crowd of copies of one text."""
    rng = random.Random(12)
    new = lambda n: [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(n)]
    texts, kinds = [], []
    for n in (60, 200, 600):
        for _ in range(8):
            base = new(n)
            cut, at = round(n * rng.uniform(0.1, 0.22)), rng.randrange(n // 2)
            block = round(n * rng.uniform(0.04, 0.11))
            copies = {"appended": base + new(round(n * rng.uniform(0.1, 0.27))), "cut": base[cut:], "block": base[:at] + new(block) + base[at + block :]}
            copies["scattered"] = [x if rng.random() > 0.022 else "edit" + x for x in base]
            for kind, copy in copies.items():  # each beside a base of its own, so that no other copy connects them
                tag = [f"{kind}{len(texts)}x{x}" for x in base]
                texts += [" ".join(tag), " ".join(dict(zip(base, tag, strict=True)).get(x, x) for x in copy)]
                kinds += [kind, kind]
    crowd = new(150)
    texts += [" ".join(x if rng.random() > 0.02 else f"e{rng.random()}" for x in crowd) for _ in range(40)]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in map(str.split, texts)]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = collections.Counter()
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                near[kinds[i] if i < len(kinds) else "crowd"] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert min(near[k] for k in ("appended", "cut", "block", "scattered", "crowd")) >= 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_each_group(df).collect()} == {i for i in range(len(texts)) if root(i) == i}


# 8. quality


def test_statistics():
    rng = random.Random(6)
    for _ in range(60):
        t = "".join(rng.choice(["a ", "b ", "c\n", "#", "! ", "\t", " ", "É "]) for _ in range(rng.randrange(0, 80)))
        w = words(t)
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        seen, dup = set(), 0
        for x in t.split("\n"):
            if words(x):
                dup += x in seen
                seen.add(x)
        assert quality.text_statistics(t)[:5] == (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(hit))
    assert quality.text_statistics(None) == (0,) * 7


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_quality_rules(spark, sf).toPandas()
    seen = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    passed = seen[~seen.base_failed]
    assert passed[passed.quality == 1].kept.mean() > 0.98 and seen[seen.quality == 0].kept.mean() < 0.3
    assert (~got[got.base_failed].kept).all()


def test_quality_on_labels_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fold = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3))
    model = quality.fit(docs, labels.where(fold != 0))
    held = docs.join(labels.where(fold == 0), "doc_id")
    got = quality.judge(held, model, "doc_id", "quality").toPandas()
    passed = got[~got.base_failed]
    assert passed[passed.quality == 1].kept.mean() > 0.97 and got[got.quality == 0].kept.mean() < 0.3


def test_quality_of_odd_rows(spark, corpus):
    df, rows = corpus
    got = quality.judge(df, None, "doc_id").collect()
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if r["base_failed"]} >= {130, 131, 132, 133, 142}
    assert quality.fit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None


def test_quality_fits_on_every_labelled_row(spark):
    """Of 20,000 labelled rows only those with the largest hashes are bad: all rows count, not the first 16,000 by hash."""
    order = [r["id"] for r in spark.range(20_000).orderBy(F.xxhash64("id"), "id").collect()]
    bad = set(order[16_000:])
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(12)) + (" # # #" if i in bad else ""), int(i not in bad)) for i in order]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(6)
    model = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    got = quality.judge(df, model, "doc_id", "quality").toPandas()
    assert got[got.quality == 1].kept.all() and not got[got.quality == 0].kept.any()
    again = quality.fit(df.repartition(3).select("doc_id", "text"), df.select("doc_id", "quality"))
    assert [m[2] for m in model] == [m[2] for m in again] and all((a[1].value == b[1].value).all() for a, b in zip(model, again, strict=True))


def test_thresholds_are_the_best_of_all_cuts(spark):
    rng = random.Random(9)
    for rows in ([(rng.randrange(12) / 8, rng.randrange(3), rng.randrange(4)) for _ in range(60)], [(0.5, 3, 0), (0.7, 1, 4)], [(0.5, 0, 3), (0.7, 0, 1)], [(0.1, 1, 0), (0.2, 0, 9), (0.3, 1, 0)]):
        cuts = sorted({s for s, _, _ in rows})
        errors = [5 * sum(g for s, g, _ in rows if s > c) + sum(b for s, _, b in rows if s <= c) for c in [-1.0, *cuts]]
        k = errors.index(min(errors))
        want = float("inf") if k == len(cuts) else (cuts[k] + cuts[k - 1]) / 2 if k else cuts[0] - 1e-9
        assert quality.calibrate(spark.createDataFrame(rows, "score double, good long, bad long")) == want
    assert quality.calibrate(spark.createDataFrame([], "score double, good long, bad long")) == float("inf")


def test_forest_finds_outliers():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(500, 3)), rng.normal(8, 1, (10, 3))])
    s = quality.fit_forest(x).scores(x)
    assert s[500:].min() > np.quantile(s[:500], 0.98)


# 9. media


@pytest.mark.parametrize("data", [b"", b"a", b"x" * 64, bytes(range(256)) * 40, b"\xff\xd8\xff\xff\x00" * 700, "é漢".encode() * 3000])
def test_media_round_trip(data):
    avi, n = media.pack_bytes(data)
    coded, found = media.clips(avi)
    payload = np.where(coded >= 0, coded, coded + 255).astype(np.uint8).tobytes()
    assert n == len(payload) == max(64, -(-len(data) // 64) * 64) and payload == data + bytes(n - len(data))
    assert found[0][1] == 0 and found[-1][1] + found[-1][2] == len(media.demux(avi)[0])


def test_general_frames_decode():
    """A frame with zero runs, an end of block and DC prediction, coded with other tables."""
    dc, ac = media._segment(0xC4, b"\0" + bytes([0, 1, 2] + [0] * 13) + bytes([0, 3, 4])), media._segment(0xC4, b"\x10" + bytes([0, 1, 2, 1] + [0] * 12) + bytes([0, 0x11, 0x02, 0xF0]))
    code = {("d", 0): "00", ("d", 3): "010", ("d", 4): "011", ("a", 0): "00", ("a", 0x11): "010", ("a", 2): "011", ("a", 0xF0): "1000"}
    bits = code["d", 3] + "101" + code["a", 2] + "10" + code["a", 0xF0] + code["a", 0x11] + "0" + code["a", 0] + code["d", 0] + code["a", 0]
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    jpeg = b"\xff\xd8" + media._segment(0xDB, b"\0" + bytes([2] * 64)) + media._segment(0xC0, b"\x08\0\x08\0\x10\x01\x01\x11\0") + dc + ac + media._segment(0xDA, b"\1\1\0\0\x3f\0") + scan + b"\xff\xd9"
    blocks, q = media.decode_frame(jpeg)
    want = np.zeros((2, 64), int)
    want[0, 0], want[0, 1], want[0, 19], want[1, 0] = 5, 2, -1, 5
    assert (blocks == want).all() and (q == 2).all()


def test_shots_and_clip_rows(spark):
    dark, light = np.full((64, 64), 200, np.uint8), np.full((64, 64), 30, np.uint8)
    hist = np.asarray([[1, 0], [0.97, 0.03], [1, 0], [0, 1], [0.02, 0.98], [0, 1.0]])
    assert media.shots(hist) == [0, 3] and media.shots(hist[:0]) == []
    avi = media.mux([media.encode_frame(x) for x in (dark, dark, light, light, light)], 64, 64)
    rows = media.media_clips(spark.createDataFrame([(1, avi), (2, None)], "doc_id long, media binary")).collect()
    assert [(r["first_frame"], r["n_frames"], r["start_s"], r["end_s"]) for r in rows] == [(0, 2, 0.0, 0.2), (2, 3, 0.2, 0.5)]
    with pytest.raises(ValueError):
        media.demux(b"RIFFxxxxWAVE")


def test_media_that_is_null_or_not_whole(spark):
    avi, n = media.pack_bytes(bytes(range(256)) * 60)
    frames, _, comment = media.demux(avi)
    assert len({struct.unpack_from(">HH", f, f.index(b"\xff\xc0") + 5) for f in frames}) == 1 and comment == b"blocks=240"
    broken = avi[:-40]
    hurt = avi.replace(frames[1][-20:], b"\x55" * 20)
    none = media.mux([], 8, 8)
    df = spark.createDataFrame([(1, 5, avi), (2, 5, None), (3, 5, broken), (4, 5, none), (5, 5, b""), (6, 5, hurt)], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in media.media_digests(df).collect()}
    assert got[1]["payload_bytes"] == n and got[2]["media_bytes"] is None and got[2]["feature"] is None
    assert all(got[k]["feature"] == "damaged" and got[k]["payload_bytes"] is None and got[k]["media_sha256"] for k in (3, 5, 6))
    assert got[4]["payload_bytes"] == 0 and got[4]["feature"] == "frames=0;shots=0;"
    cut = media.media_clips(df).collect()
    assert {r["doc_id"] for r in cut if r["error"]} == {3, 5, 6} and all(r["clip"] is None for r in cut if r["error"])
    assert {r["doc_id"] for r in cut if not r["error"]} == {1}


def test_media_digests(corpus):
    df, rows = corpus
    got = media.media_digests(media.to_media(df)).collect()
    want = collections.Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    assert all(r["media_bytes"] > r["payload_bytes"] and r["feature"].startswith("frames=") for r in got)


# 10. sharding


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 2000])
def test_sharding(corpus, bucket_bytes):
    df, rows = corpus
    out = sharding.external_shuffle(df, bucket_bytes=bucket_bytes).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in out) == collections.Counter(r[:2] for r in rows)
    per = collections.defaultdict(list)
    for r in out:
        per[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    counts = [len(per.get(s, [])) for s in range(16)]
    assert set(per) <= set(range(16)) and max(counts) - min(counts) <= 1
    again = sharding.external_shuffle(df.repartition(3), bucket_bytes=bucket_bytes).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_fisher_yates_is_uniform():
    seen = collections.Counter(tuple(sharding.fisher_yates(3, [k, 1])) for k in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400
    assert list(sharding.fisher_yates(0, [1])) == [] and list(sharding.fisher_yates(1, [1])) == [0]


# shared parts and empty tables


def test_prefix_sums(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(100)) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, v long")
    want = dict(zip((k for k, _ in rows), itertools.accumulate([0, *(v for _, v in rows)]), strict=False))
    assert {r["k"]: r["v_before"] for r in ordered_prefix(df, ["k"], ["v"], "x").collect()} == want
    assert {r["k"]: r["o"] for r in prefix_by_key(df, "k", "v", "o", chunk=64).collect()} == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}


def test_empty_tables(spark):
    e = empty(spark)
    path = fresh_path(spark, "e")
    token_output.write_tokens(e, path, public_tokenizers.path("word_bpe_49k.json"), 2)
    for out in (
        packing.pack(e), token_output.token_digests(token_output.read_tokens(spark, path)), mixing.mix(e), mixing.apply_mix(e), substrings.remove_repeats(e), lines.drop_boilerplate(e),
        simhash.near_duplicates(e), simhash.one_of_each_group(e), quality.judge(e, None, "doc_id"), media.media_digests(media.to_media(e)), sharding.external_shuffle(e),
    ):
        assert out.count() == 0


def test_parity_maps_lose_no_pair_and_fingerprints_link_first(spark):
    """Pairs at and around the similarity all stay; unlike ones go without their texts; copies but for a word in 400 are linked by SimHash."""
    rng = np.random.default_rng(9)
    rows, pairs, alike = [], [], set()
    for k in range(60):
        n, gone = int(rng.integers(1, 400)), float(rng.uniform(0, 0.3))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) >= gone], rng.integers(0, 1 << 63, 3, dtype=np.uint64)]))
        rows += [(2 * k, len(x), simhash.parity_map(x)), (2 * k + 1, len(y), simhash.parity_map(y))]
        pairs.append((2 * k, 2 * k + 1))
        both = len(np.intersect1d(x, y))
        alike |= {pairs[-1]} if both >= 0.8 * (len(x) + len(y) - both) else set()
    far = [(a, b) for a in range(0, 120, 2) for b in range(a + 2, 120, 2)]
    classes = spark.createDataFrame(rows, "class long, n int, parity binary")
    got = {tuple(r) for r in simhash._possible(spark.createDataFrame(pairs + far, "a long, b long"), classes, 0.8).collect()}
    assert 10 < len(alike) and alike <= got and len(got & set(far)) < 0.02 * len(far)
    text = [f"w{rng.integers(5000)}" for _ in range(400)]
    hashed = [simhash.fingerprint(simhash.shingle_hashes(" ".join(t), 5)) for t in (text, [*text[:-1], "other"], text[::-1])]
    found = simhash._fingerprint_pairs(spark.createDataFrame([(k, f) for k, f in enumerate([*hashed, hashed[0]])], "class long, fp long"), 6).collect()
    assert (0, 3) in found and any({r["a"], r["b"]} <= {0, 1} for r in found) and all(2 not in r for r in found)
