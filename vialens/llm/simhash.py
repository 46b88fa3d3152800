"""SimHash near-duplicates by the generalised pigeonhole: groups of correlated bits, unequal thresholds, probe and verify."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vialens.llm.common import discard, row_key, small, whole_row, written
from vialens.llm.components import components

BITS = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words (A-Z lower-cased, joined by spaces; fewer words: all of them), repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.asarray([hashed(joined, seed)], np.uint64)
    ends = list(itertools.accumulate(map(len, parts), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    return np.asarray([hashed(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit, whether over half of the hashes have it; zero without any. As a signed 64-bit integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``doc_id, fp`` of every row of ``docs`` (``doc_id``, ``text``; other columns are ignored; null texts have fp 0)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                b = batch.slice(k, 1000)
                fp = [fingerprint(shingle_hashes(t, shingle_words)) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(hashed, "doc_id bigint, fp bigint")


@dataclass(frozen=True)
class Part:
    """Bits of the fingerprint (0 is the lowest), and the differing bits allowed among them (-1: not probed)."""

    bits: tuple[int, ...]
    most: int

    @property
    def mask(self) -> int:
        m = sum(1 << b for b in self.bits)
        return m - (1 << 64) if m >> 63 else m


def bit_statistics(fps: DataFrame) -> tuple[np.ndarray, int]:
    """Over all fingerprints: the 64 x 64 counts of bits set together, and the number of fingerprints."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = b.column("fp").to_numpy(zero_copy_only=False).astype("<i8")
            for k in range(0, len(x), 1 << 15):
                bits = np.unpackbits(x[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(total.ravel()), pa.array(np.full(BITS * BITS, n, np.int64))], names=["cell", "both", "n"])

    rows = fps.select("fp").mapInArrow(gram, "cell int, both double, n bigint").groupBy("cell").agg(F.sum("both"), F.sum("n")).collect()  # 4,096 rows
    out = np.zeros(BITS * BITS)
    for cell, both, _ in rows:
        out[cell] = both
    return out.reshape(BITS, BITS), int(rows[0][2]) if rows else 0


def correlated_groups(both: np.ndarray, n: int, parts: int) -> list[tuple[int, ...]]:
    """Bits in ``parts`` groups of nearly equal size: each group starts from the free bit with the strongest correlations
    and takes, one by one, the free bit most correlated with the group."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (corr[b, group].sum(), -b)))
            free.remove(group[-1])
        out.append(tuple(sorted(group)))
    return out


def plan_parts(fps: DataFrame, most: int, probe_cost: float = 4.0) -> list[Part]:
    """The partition of the bits and the threshold of each part with the least estimated cost, over 1 to ``most`` + 2 parts.

    By the generalised pigeonhole, if the thresholds (-1 or more) of m parts sum to ``most`` - m + 1, any two fingerprints
    within ``most`` bits are within the threshold in some part. A part's candidates at 0 bits are the pairs that agree in it,
    counted over all fingerprints; at t bits they grow with the odds that bits differ. Dynamic programming over the parts
    and the sum that is left allots the thresholds; a probe weighs ``probe_cost`` candidates.
    """
    both, n = bit_statistics(fps)
    shapes = {m: correlated_groups(both, n, m) for m in range(1, most + 3)}
    masks = {g: Part(g, 0).mask for gs in shapes.values() for g in gs if len(g) < BITS}
    agree = {}
    keyed = fps.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(masks.values())))).alias("x")).select("x.*")
    for r in keyed.groupBy("k", "v").count().groupBy("k").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).collect():  # a row a part
        agree[list(masks)[r[0]]] = r[1]
    set_share = np.diag(both) / max(n, 1)
    differ = np.clip(2 * set_share * (1 - set_share), 1e-6, 0.5)
    odds = differ / (1 - differ)

    def cost(group: tuple[int, ...], t: int) -> float:
        if t < 0:
            return 0.0
        ways = np.zeros(t + 1)  # elementary symmetric sums of the odds: sets of up to t differing bits
        ways[0] = 1
        count = np.zeros(t + 1)
        count[0] = 1
        for b in group:
            for j in range(t, 0, -1):
                ways[j] += ways[j - 1] * odds[b]
                count[j] += count[j - 1]
        pairs = agree.get(group, n / 2.0**len(group)) * ways.sum()
        return float(pairs + probe_cost * n * count.sum())

    best: tuple[float, list[Part]] = (float("inf"), [])
    for m, groups in shapes.items():
        table = {0: (0.0, [])}  # sum of thresholds plus one so far -> cost and parts
        for g in groups:
            new: dict = {}
            for used, (c, parts) in table.items():
                for t in range(-1, most - used + 1):
                    x = (c + cost(g, t), [*parts, Part(g, t)])
                    if used + t + 1 not in new or x[0] < new[used + t + 1][0]:
                        new[used + t + 1] = x
            table = new
        if most + 1 in table and table[most + 1][0] < best[0]:
            best = table[most + 1]
    return [p for p in best[1] if p.most >= 0]


def _flips(bits: tuple[int, ...], most: int) -> list[int]:
    """XOR masks, as signed longs, of all sets of up to ``most`` of the bits."""
    out = [sum(1 << b for b in c) for k in range(most + 1) for c in itertools.combinations(bits, k)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(fps: DataFrame, most: int = 2, parts: list[Part] | None = None, hot: int = 256) -> DataFrame:
    """Edges (``a``, ``b``) over distinct fingerprints ``fp`` that connect exactly those within ``most`` bits of each other.

    Each fingerprint is stored under its bits in each part and probes there with up to the part's threshold of bits
    flipped; pairs that meet are verified by the number of differing bits. Under a key with more than ``hot``
    fingerprints no pairs are made: its fingerprints are linked through shared neighbours (``_star_links``), which is exact too.
    """
    parts = plan_parts(fps, most) if parts is None else parts
    stored = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(p.mask)).alias("v")) for k, p in enumerate(parts)))).alias("x")).select("fp", "x.*")
    crowded = stored.groupBy("k", "v").count().where(F.col("count") > hot).select("k", "v")
    crowded = written(crowded, "crowded")  # keys with over `hot` fingerprints each: at most parts * n / hot
    few = crowded.isEmpty()
    calm = stored if few else stored.join(crowded, ["k", "v"], "left_anti")
    if all(p.most == 0 for p in parts):
        probes = calm
    else:
        flips = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseXOR(F.lit(m)).bitwiseAND(F.lit(p.mask)).alias("v")) for k, p in enumerate(parts) for m in _flips(p.bits, p.most)]
        probes = fps.select("fp", F.explode(F.array(*flips)).alias("x")).select("fp", "x.*")
    near = calm.alias("s").join(probes.alias("p"), ["k", "v"]).where("s.fp < p.fp").where(F.bit_count(F.expr("s.fp ^ p.fp")) <= most)
    found = near.select(F.col("s.fp").alias("a"), F.col("p.fp").alias("b"))
    if few:
        return found
    # a probe that reaches a crowded key may link to any fingerprint there, so the probe joins them
    reach = stored if all(p.most == 0 for p in parts) else probes
    members = reach.join(crowded, ["k", "v"], "left_semi").select("fp").distinct()
    return found.union(_star_links(members, most))


def _star_links(fps: DataFrame, most: int) -> DataFrame:
    """Edges that connect all given fingerprints within ``most`` (2) bits, without making pairs.

    Two fingerprints within 2 bits share a value within 1 bit of both, and any two that share such a value are within 2;
    so each is put under its value and the 64 values one bit away, and each key links its members to its least.
    """
    if most != 2:
        raise ValueError("crowded keys are linked for 2 bits only")
    around = fps.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(m)) for m in _flips(tuple(range(BITS)), 1)))).alias("v"))
    least = around.groupBy("v").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a != top")
    return around.join(least, "v").where("fp != a").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 3, most: int = 2, hot: int = 256) -> DataFrame:
    """``doc_id, fp, component_id``: a row for each row of ``docs``, the component being the least doc_id reachable by links.

    Null texts count as empty; texts without a word all have fingerprint zero and link to each other. Rows with a null
    doc_id take part; a component of such rows alone has a null id. Equal fingerprints are one class from the start, so a
    group of copies costs one row; an empty table gives no rows.
    """
    fps = written(fingerprints(docs, shingle_words), "fp")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    nodes = components(links(classes.select("fp"), most, hot=hot))
    named = classes.join(nodes, classes["fp"] == nodes["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(roots, "root").select("fp", "component_id"), "named")
    discard(classes)
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def least_overlap(similarity: float, n: Column | int, m: Column | int) -> Column:
    """Shared elements that sets of ``n`` and ``m`` elements have at least if their Jaccard similarity is ``similarity`` or more."""
    return F.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)


def _common(docs: DataFrame, shingle_words: int, sample: int = 20_000, least: int = 4, most_held: int = 65_536) -> np.ndarray:
    """Hashes of shingles that ``least`` or more of about ``sample`` texts share, the rarest first, of the most frequent ones ``most_held``.
    They only order the shingles; any order finds the same pairs."""
    rate = max(1, docs.count() // sample)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                h = [np.unique(shingle_hashes(t, shingle_words)) for t in b.column("text").slice(k, 1000).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64))], names=["h"])

    some = docs.where(F.pmod(F.xxhash64("row_key"), F.lit(rate)) == 0).select("text")
    counts = some.mapInArrow(hashed, "h bigint").groupBy("h").count().where(F.col("count") >= least)
    rows = counts.orderBy(F.desc("count"), "h").limit(most_held).collect()  # 65,536 numbers at most
    return np.asarray([r["h"] for r in reversed(rows)], np.int64).view(np.uint64)


#: Bits of a set's parity map.
PARITY = 1024


def parity_map(hashes: np.ndarray) -> bytes:
    """Of each of PARITY bits, whether an odd number of the distinct ``hashes`` fall on it. The maps of two sets differ in at most as
    many bits as there are elements in only one of the sets."""
    return np.packbits(np.bincount((hashes % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).tobytes()


def _marks(docs: DataFrame, shingle_words: int, similarity: float, common: np.ndarray) -> DataFrame:
    """``row_key, id, words, n, fp, parity, keys`` of each row: 128 bits of its lower-cased words in turn, the number of its distinct
    shingles, the fingerprint of all and the parity map of the distinct ones, and the rarest of them: so many that any two sets of the
    similarity share one, whichever is the larger."""
    by_hash = np.argsort(common)
    ordered = common[by_hash]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                b, classes, sizes, fps, parity, keys = batch.slice(k, 1000), [], [], [], [], []
                for t in b.column("text").to_pylist():
                    classes.append(xxhash.xxh128_digest(b" ".join((t or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()), 7))
                    h = shingle_hashes(t, shingle_words)
                    fps.append(fingerprint(h))
                    h = np.unique(h)
                    sizes.append(len(h))
                    parity.append(parity_map(h))
                    if len(ordered):
                        at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
                        h = h[np.argsort(np.where(ordered[at] == h, by_hash[at] + 1, 0), kind="stable")]
                    keys.append(h[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1].view(np.int64))
                columns = [pa.array(classes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(parity, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column("row_key"), b.column("id"), *columns], names=["row_key", "id", "words", "n", "fp", "parity", "keys"])

    return docs.select("row_key", F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(marked, "row_key binary, id bigint, words binary, n int, fp bigint, parity binary, keys array<bigint>")


def _possible(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b: classes) whose parity maps differ in no more bits than sets of their sizes and the similarity can. No
    pair of the similarity is lost, and nearly all others are told without their texts."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("na", "nb"))
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u8").reshape(-1, PARITY // 64) for c in ("pa", "pb"))
            most = n + m - 2 * np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
            ok = pa.array(np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    of = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(near, "a bigint, b bigint")


def _fingerprint_pairs(classes: DataFrame, most: int) -> DataFrame:
    """Pairs of classes that SimHash links: each with the first class of its fingerprint, and the first ones of fingerprints within ``most`` bits."""
    heads = written(classes.groupBy("fp").agg(F.min("class").alias("head")), "heads")
    same = classes.select("fp", "class").join(heads, "fp").where("class != head").select(F.col("head").alias("a"), F.col("class").alias("b"))
    near = links(heads.select("fp"), most)
    of = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}"))
    return same.union(near.join(of("a"), "a").join(of("b"), "b").select(F.least("head_a", "head_b"), F.greatest("head_a", "head_b"))).distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b and more) that are not in one component by ``roots`` (node, root)."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    met = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return met.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)


def _verified(pairs: DataFrame, texts: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b: classes) whose sets of word shingles have a Jaccard similarity of ``similarity`` or more."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (batch.slice(k, 500) for batch in batches for k in range(0, batch.num_rows, 500))  # so many texts at once as Python objects
        for b in slices:
            last, mine, ok = None, np.zeros(0), []
            for a, x, y in zip(b.column("a").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                if a != last:
                    last, mine = a, np.unique(shingle_hashes(x, shingle_words))
                other = np.unique(shingle_hashes(y, shingle_words))
                both = len(np.intersect1d(mine, other, assume_unique=True))
                ok.append(both >= similarity * max(1, len(mine) + len(other) - both))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok, pa.bool_())), b.column("b").filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    # b first: its text goes to a's, so that the text of a group's leader isn't sent again for every member
    wide = pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("class").alias("a"), F.col("text").alias("x")), "a")
    return wide.select("a", "b", "x", "y").mapInArrow(alike, "a bigint, b bigint")


def one_of_each_group(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, most: int = 2) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the least doc_id (null last).

    Near-duplicates are texts whose sets of ``shingle_words``-word shingles have a Jaccard similarity of ``similarity`` or more; all
    pairs of them are found. Texts with equal lower-cased words are one class from the start. First come the pairs that SimHash links:
    fingerprints within ``most`` bits by the generalised pigeonhole. Fingerprints of texts at the similarity are often farther away, so the
    rest are candidates that share one of their rarest shingles, so many of each as the similarity allows to differ (prefix filtering),
    if their sizes, the shared shingle's places and their parity maps allow the similarity. Of these each class is first held against a
    leader of a crowded shingle, so that a large group becomes one component by a link a member; then all candidates in different
    components are taken. Every pair is verified by its texts, those of the fingerprints too. Groups are
    the components of verified links. Null texts and texts without words form one group; of repeated rows one stays; all columns
    are kept; an empty table stays empty.
    """
    names = docs.columns
    # the columns of docs go along in a struct, so that none of their names clashes
    keyed = docs.select(whole_row(names).alias("row"), row_key(names).alias("row_key"))
    plain = docs.select(row_key(names).alias("row_key"), "doc_id", "text")
    common = _common(plain, shingle_words)
    marks = written(_marks(plain, shingle_words, similarity, common), "marks")
    classes = marks.groupBy("words").agg(F.min(F.struct("row_key", "n", "fp", "parity", "keys")).alias("m")).select("words", "m.*")
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")  # written, so that the numbers stay
    held = written(_shared_keys(classes), "held")

    def verified(pairs: DataFrame) -> DataFrame:
        candidates = written(pairs, "candidates")
        pairs = written(_possible(candidates, classes, similarity), "pairs")
        discard(candidates)
        wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes.select("class", "row_key"), "class"), "wanted")
        texts = plain.select("row_key", "text").join(small(wanted), "row_key").dropDuplicates(["class"]).select("class", "text")
        found = written(_verified(pairs, texts, shingle_words, similarity), "links")
        discard(pairs, wanted)
        return found

    led = verified(_fingerprint_pairs(classes, most))
    led = led.union(verified(_leader_pairs(held, similarity, components(led))))
    roots = components(led)
    rooted = held.join(roots, held["class"] == roots["node"], "left").select(*held.columns, F.coalesce("root", "class").alias("root"))
    rooted = written(rooted, "rooted")
    discard(held)
    nodes = components(led.union(verified(_pairs_across(rooted, similarity))))
    roots = classes.select("words", "class").join(nodes, classes["class"] == nodes["node"], "left").select("words", F.coalesce("root", "class").alias("root"))
    named = marks.select("row_key", "id", "words").join(roots, "words")
    best = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key")).alias("m"))
    gone = named.join(best, "root").where(F.col("row_key") != F.col("m.row_key")).select("row_key").distinct()
    gone = written(gone, "gone")
    out = keyed.join(small(gone), "row_key", "left_anti")
    if marks.groupBy("row_key").count().where("count > 1").limit(1).count():  # equal rows
        out = out.groupBy("row_key").agg(F.first("row").alias("row"))
    discard(marks, classes, rooted, led)
    return out.select("row.*")


def _shared_keys(classes: DataFrame) -> DataFrame:
    """``key, class, n, at, sharers``: the keys that two classes or more have, with the key's place in the class and its classes."""
    each = classes.select("class", "n", F.posexplode("keys").alias("at", "key"))
    return each.withColumn("sharers", F.count("*").over(Window.partitionBy("key"))).where("sharers > 1")


def _may_match(similarity: float) -> Column:
    """Whether the sizes of rows s and p allow the similarity, and the places of the key that they share allow it to be their first one.
    The first shared key of two sets of the similarity is always in both places."""
    overlap = least_overlap(similarity, F.col("s.n"), F.col("p.n"))
    return (F.least("s.n", "p.n") >= overlap) & (F.col("s.at") <= F.col("s.n") - overlap) & (F.col("p.at") <= F.col("p.n") - overlap)


def _leader_pairs(held: DataFrame, similarity: float, roots: DataFrame, crowd: int = 8) -> DataFrame:
    """Pairs, in different components by ``roots``, of a leader ``a`` and a class ``b``, one a class at most: of the leaders of its keys, the one that leads most of them.
    A key with ``crowd`` classes or more has a leader: the class whose keys are shared most, so that of copies edited at random
    the text they stem from leads, if it is there."""
    shared = held.groupBy("class").agg((F.sum("sharers") / F.first("n")).alias("shared"))
    crowded = written(held.where(F.col("sharers") >= crowd).join(shared, "class"), "crowded")
    first = crowded.groupBy("key").agg(F.max(F.struct("shared", "class", "n", "at")).alias("l")).select("key", "l.class", "l.n", "l.at")
    met = crowded.alias("p").join(written(first, "leaders").alias("s"), "key").where((F.col("s.class") != F.col("p.class")) & _may_match(similarity))
    met = met.groupBy(F.col("p.class").alias("b"), F.col("s.class").alias("a")).agg(F.count("*").alias("led"))
    return _apart(met, roots).groupBy("b").agg(F.max(F.struct("led", "a")).alias("m")).select("m.a", "b")


def _pairs_across(rooted: DataFrame, similarity: float) -> DataFrame:
    """All candidates (a < b) with different ``root``."""
    near = rooted.alias("s").join(rooted.alias("p"), "key").where((F.col("s.root") != F.col("p.root")) & (F.col("s.class") < F.col("p.class")) & _may_match(similarity))
    return near.select(F.col("s.class").alias("a"), F.col("p.class").alias("b")).distinct()
