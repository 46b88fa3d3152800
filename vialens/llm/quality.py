"""Quality rules: statistics of every text, an isolation forest on them, a threshold calibrated on labelled rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialens.llm.common import column, discard, ordered_prefix, written

#: Trees of a forest, and the rows that each of them draws from all that fit: an isolation tree is grown on a few rows of its own.
TREES, TREE_ROWS = 50, 256
#: A good row rejected counts as many errors as this many bad rows kept.
GOOD_LOST = 5
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
EXTRA = "n_upper long, n_bangs long"
FEATURES = ("symbol_rate", "bang_rate", "upper_rate", "repeat_rate", "dup_line_rate")
#: The features among which a forest splits: each alone, then all. A trait that is rare in good documents too, such as a
#: repeated line, then gets a threshold of its own and doesn't hide the others.
GROUPS = ((0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4))
#: Of the rows that a tree draws, about this share at most is labelled bad: anomalies have to be few, but the splits must reach them.
CONTAMINATION = 0.03


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words in ``window``-word windows found twice or more, the first one included."""
    windows = list(zip(*(words[k:] for k in range(window)), strict=False))
    seen: set = set()
    if len(set(windows)) == len(windows):
        return 0
    twice = {w for w in windows if w in seen or seen.add(w)}
    covered, reach = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + window - max(i, reach)
            reach = i + window
    return covered


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The base statistics and the further ones, in the order of BASE and EXTRA; all are zero for null."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at space and U+0009..U+000D only
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else []
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        sum(map(bytes.isupper, words)),
        text.count("!"),
    )


def base_failed(s: pd.DataFrame) -> pd.Series:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def features(s: pd.DataFrame) -> np.ndarray:
    """Rates that do not depend on a text's length, each squeezed by a logarithm so that shares well below the largest still count."""
    n = np.maximum(s["n_words"].to_numpy(float), 1)
    rates = [s[c].to_numpy(float) / n for c in ("n_symbols", "n_bangs", "n_upper", "n_repeat_words", "n_dup_lines")]
    return np.column_stack([np.log1p(4 * r) for r in rates])


@dataclass
class Forest:
    """An isolation forest as arrays (tree, node): split feature (-1: leaf), split value, children at 2i+1 and 2i+2, path length at leaves."""

    feature: np.ndarray
    value: np.ndarray
    length: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1): 2 to the power of minus the mean path length over that of a random tree."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for f, v, length in zip(self.feature, self.value, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(TREE_ROWS))):
                at = f[node]
                node = np.where(at < 0, node, 2 * node + 1 + (x[rows, np.maximum(at, 0)] >= v[node]))
            total += length[node]
        return 2.0 ** (-total / len(self.length) / mean_path(TREE_ROWS))


#: Features, forest, threshold.
Judge = tuple[tuple[int, ...], Forest, float]


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a random binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def fit_tree(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree's feature, value and length by node: random splits of random features; the depth is log2 of TREE_ROWS."""
    depth = int(math.log2(TREE_ROWS))
    size = 2 ** (depth + 1) - 1
    feature, value, length = np.full(size, -1), np.zeros(size), np.zeros(size)
    todo = [(0, x, 0)]
    while todo:
        node, part, level = todo.pop()
        spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) else []
        if level == depth or len(part) < 2 or not len(spread):
            length[node] = level + mean_path(len(part))
            continue
        f = int(rng.choice(spread))
        v = rng.uniform(part[:, f].min(), part[:, f].max())
        feature[node], value[node] = f, v
        todo += [(2 * node + 1, part[part[:, f] < v], level + 1), (2 * node + 2, part[part[:, f] >= v], level + 1)]
    return feature, value, length


def fit_forest(x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 8) -> Forest:
    """A forest over rows at hand, each tree on a random subset of them."""
    rng = np.random.default_rng(seed)
    grown = [fit_tree(x[rng.choice(len(x), min(rows, len(x)), replace=False)], rng) for _ in range(trees)]
    return Forest(*(np.stack(part) for part in zip(*grown, strict=True)))


def calibrate(scores: DataFrame) -> float:
    """The threshold (reject above) with the fewest errors over all ``scores`` (``score, good, bad``: longs, how many rows).

    Equal scores stay together. Running sums over the sorted scores tell what each cut does; a task holds a range of them.
    """
    counts = scores.groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    placed = written(ordered_prefix(counts, ["score"], ["good", "bad"], "calibrate"), "cuts")
    # errors of a cut above a score, less those of rejecting all
    change = (F.col("bad_before") + F.col("bad")) - GOOD_LOST * (F.col("good_before") + F.col("good"))
    best = placed.agg(F.min(F.struct(change.alias("change"), "score")).alias("b")).first()["b"]
    if best is None:
        return float("inf")
    least, above = placed.agg(F.min("score"), F.min(F.when(F.col("score") > best["score"], F.col("score")))).first()
    discard(placed)
    if best["change"] >= 0:
        return least - 1e-9
    return float("inf") if above is None else (best["score"] + above) / 2


def text_table(texts: pd.Series) -> pd.DataFrame:
    """The statistics of whole texts, a row each."""
    names = [c.split()[0] for c in f"{BASE}, {EXTRA}".split(", ")]
    return pd.DataFrame([text_statistics(t) for t in texts], columns=names, dtype="int64", index=texts.index)


_RATES = ", ".join(f"f{k} double" for k in range(len(FEATURES)))
_RATE_NAMES = [f"f{k}" for k in range(len(FEATURES))]
_STEP, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _chance(h: np.ndarray, tree: int) -> np.ndarray:
    """A number in [0, 1) for each row's hash and a tree."""
    with np.errstate(over="ignore"):
        z = h + _STEP * np.uint64(tree + 1)
        z = (z ^ (z >> np.uint64(30))) * _MIX_A
        z = (z ^ (z >> np.uint64(27))) * _MIX_B
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def labelled_rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``__id, good, f0 ...``: the features of every labelled row that the base rules accept, written. Only labels of 0 or 1 count; an id
    with both is good. Texts stay where they are read: what is joined is their features."""

    def rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            table = text_table(b["text"])
            passed = ~base_failed(table).to_numpy()
            out = pd.DataFrame(features(table[passed]), columns=_RATE_NAMES)
            out.insert(0, "__id", b["__id"].to_numpy()[passed])
            yield out

    own = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and __id is not null")
    own = own.groupBy("__id").agg((F.max("quality") == 1).alias("good"))
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text")).where("__id is not null")
    return written(rows.mapInPandas(rates, f"__id long, {_RATES}").join(own, "__id").select("__id", "good", *_RATE_NAMES), "labelled")


def fit(docs: DataFrame, labels: DataFrame) -> list[Judge] | None:
    """Forests and thresholds from all labelled rows: those of one half fit, those of the other calibrate, told by a hash of their ids.

    Tables in which a half has under 16 rows of a kind use all rows for both. None if there are under four of either kind: nothing
    is then rejected but by the base rules.
    """
    rows = labelled_rates(docs, labels)
    fits = F.xxhash64(F.lit("fit"), "__id") % 2 == 0
    good = F.col("good")
    n = rows.agg(*(F.count_if(c & h).alias(f"{a}{b}") for a, c in (("good", good), ("bad", ~good)) for b, h in (("_fit", fits), ("_probe", ~fits)))).first().asDict()
    if n["good_fit"] + n["good_probe"] < 4 or n["bad_fit"] + n["bad_probe"] < 4:
        discard(rows)
        return None
    if min(n.values()) < 16:
        fitted, probe, n_good, n_bad = rows, rows, n["good_fit"] + n["good_probe"], n["bad_fit"] + n["bad_probe"]
    else:
        fitted, probe, n_good, n_bad = rows.where(fits), rows.where(~fits), n["good_fit"], n["bad_fit"]
    out = fit_groups(fitted, n_good, n_bad, probe)
    discard(rows)
    return out


def fit_forests(rows: DataFrame, n_good: int, n_bad: int, trees: int = TREES, size: int = TREE_ROWS) -> list[Forest]:
    """A forest for each group of features. Each tree draws ``size`` of all ``rows`` (``n_good`` and ``n_bad`` of them) anew: the rows of
    the least numbers by a hash of row and tree, where a bad row's are larger, so that about CONTAMINATION of a tree's rows are bad."""
    weight = min(1.0, CONTAMINATION * n_good / max(1, n_bad))
    most = 2.0 * size / (n_good + weight * n_bad)  # twice as many as are needed are expected below; the task takes the first
    names = ["good", "h", *_RATE_NAMES]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, w = b["h"].to_numpy().view(np.uint64), np.where(b["good"], 1.0, weight)
            for t in range(trees * len(GROUPS)):
                at = _chance(h, t) / w
                chosen = at < most
                yield b.loc[chosen, _RATE_NAMES].assign(tree=np.int32(t), at=at[chosen])[["tree", "at", *_RATE_NAMES]]

    def grow(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        (t,) = key
        x = b.sort_values(["at", *_RATE_NAMES])[_RATE_NAMES].to_numpy()[:size][:, GROUPS[t // trees]]
        feature, value, length = fit_tree(x, np.random.default_rng((8, t)))
        return pd.DataFrame({"tree": [t], "feature": [feature], "value": [value], "length": [length]})

    named = rows.withColumn("h", F.xxhash64("__id", *_RATE_NAMES)).select(*names)
    drawn = named.mapInPandas(draw, f"tree int, at double, {_RATES}")
    grown = drawn.groupBy("tree").applyInPandas(grow, "tree int, feature array<int>, value array<double>, length array<double>").toPandas()  # a row a tree
    parts = [grown[grown["tree"] // trees == k].sort_values("tree") for k in range(len(GROUPS))]
    return [Forest(*(np.stack(p[c].to_list()) for c in ("feature", "value", "length"))) for p in parts]


def fit_groups(rows: DataFrame, n_good: int, n_bad: int, probe: DataFrame) -> list[Judge]:
    """A forest for each group of features, its threshold calibrated on those of ``probe`` that no forest before it rejects."""
    forests = fit_forests(rows, n_good, n_bad)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[_RATE_NAMES].to_numpy()
            yield pd.DataFrame({"good": b["good"].astype("int64"), "bad": (~b["good"]).astype("int64"), **{f"s{k}": f.scores(x[:, g]) for k, (g, f) in enumerate(zip(GROUPS, forests, strict=True))}})

    scores = ", ".join(f"s{k} double" for k in range(len(GROUPS)))
    scored = written(probe.select("good", *_RATE_NAMES).mapInPandas(score, f"good long, bad long, {scores}"), "scores")
    out: list[Judge] = []
    left = scored
    for k, (group, forest) in enumerate(zip(GROUPS, forests, strict=True)):
        out.append((group, forest, calibrate(left.select(F.col(f"s{k}").alias("score"), "good", "bad"))))
        left = left.where(F.col(f"s{k}") <= out[-1][2])
    discard(scored)
    return out


def excess(model: list[Judge] | None, x: np.ndarray) -> np.ndarray:
    """By how much each row's anomaly exceeds a forest's threshold, at most over the forests; rejected above 0."""
    out = np.full(len(x), -1.0)
    for group, forest, most in (model or []) if len(x) else []:
        out = np.maximum(out, forest.scores(x[:, group]) - most)
    return out


def _judged(docs: DataFrame, model: list[Judge] | None, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` as __k0, __k1 ..., the statistics and the verdict of every row."""
    rows = docs.select(*(column(c).alias(f"__k{i}") for i, c in enumerate(keep)), *([] if "text" in keep else [F.col("text").cast("string").alias("__text")]))
    text = f"__k{keep.index('text')}" if "text" in keep else "__text"

    def verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for given in batches:
            b = text_table(given[text])
            failed = base_failed(b)
            over = excess(model, features(b))
            judged = b.assign(base_failed=failed, anomaly=over, kept=~failed & (over <= 0))
            yield pd.concat([given[[f"__k{i}" for i in range(len(keep))]], judged], axis=1)

    head = "".join(f"__k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    return rows.mapInPandas(verdicts, f"{head}{BASE}, {EXTRA}, base_failed boolean, anomaly double, kept boolean")


def accept(docs: DataFrame, model: list[Judge] | None) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, that ``judge`` keeps."""
    return _judged(docs, model, tuple(docs.columns)).where("kept").select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(docs.columns)))


def judge(docs: DataFrame, model: list[Judge] | None, *keep: str) -> DataFrame:
    """``keep`` columns, the base statistics, ``base_failed``, ``anomaly`` and ``kept`` of every row of ``docs``.

    A null or empty text has no words and fails the base rules; repeated rows get the same verdict; an empty table
    gives none; other columns are ignored.
    """
    out = _judged(docs, model, keep)
    base = [c.split()[0] for c in BASE.split(", ")]
    return out.select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)), *base, "base_failed", "anomaly", "kept")
