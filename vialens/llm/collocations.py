"""Phrase collocations: frequent phrases of 2 to 5 words, scored at their weakest cut, longest ones first.

Texts are exploded into rows of n-grams, one length after the other, and counted by hash aggregation per language. No phrase is
more frequent than a part of it, and a candidate's parts are all that its score needs, so an n-gram becomes a row only if both
(n - 1)-grams in it can be frequent. That is told by a Bloom filter over the frequent ones, of bounded size: it lets some
phrases through that the count then drops, never the other way round, so results are exact at any size.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vialens.llm.common import discard, written

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Characters that end a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(ord(".") if c in ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TEXT_BYTES, _KEPT_WORDS = 6 << 20, 200_000
_CHUNK_BITS, _MOST_BITS = 16, 28


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z only), with b"." between pieces."""
    return text.translate(_TABLE).replace(b".", b" . ").split()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _ODD + b
    x ^= x >> np.uint64(29)
    x *= _MIX
    return x ^ (x >> np.uint64(32))


def phrase_hashes(words: list[np.ndarray]) -> np.ndarray:
    """The hash of phrases, given the hashes of their first words, second words and so on."""
    h = words[0]
    for w in words[1:]:
        h = mix(h, w)
    return h


def probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a phrase in a filter of 2 ** bits bits."""
    shift = np.uint64(64 - bits)
    return h >> shift, (h * _MIX) >> shift


class _Words(dict):
    """Words of a language as dense numbers, with their hashes; -1 where a piece ends. Begun anew when there are too many."""

    def __init__(self, lang: str):
        self.seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
        self.begin()

    def begin(self) -> None:
        self.clear()
        self[b"."] = -1
        self.words, self.hashes = [], array("Q")

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return number

    def encode(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > _KEPT_WORDS:
            self.begin()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _ngram_rows(n: int, held: bytes | None, bits: int):
    """A task's rows of n-grams, summed over some 6 MB of one language's texts at a time."""

    def rows(lang: str, words: _Words, texts: list[bytes]) -> pa.RecordBatch:
        code = words.encode(tokens(b".".join(texts)))
        count = len(code) - n + 1
        if count <= 0:
            code, count = np.zeros(0, np.int64), 0
        good = np.ones(count, bool)
        for k in range(n):
            good &= code[k : k + count] >= 0
        if held is not None and count:
            bitmap = np.frombuffer(held, np.uint8)
            h = np.append(np.asarray(words.hashes, np.uint64), np.uint64(0))[code]
            part = phrase_hashes([h[k : k + count + 1] for k in range(n - 1)])
            seen = np.ones(count + 1, bool)
            for at in probes(part, bits):
                seen &= (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            good &= seen[:-1] & seen[1:]
        start = np.flatnonzero(good)
        number = code[start]
        for k in range(1, n):  # numbers of phrases that are one word longer, still exact
            _, number = np.unique(number * (len(words.words) + 1) + code[start + k], return_inverse=True)
        _, first, total = np.unique(number, return_index=True, return_counts=True)
        table = pa.array(words.words, pa.binary())
        columns = [table.take(pa.array(code[start[first] + k])) for k in range(n)]
        phrase = columns[0] if n == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), phrase, pa.array(total.astype(np.int64))], names=["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, _Words] = {}
        texts: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes()
                texts.setdefault(lang, []).append(raw)
                size[lang] = size.get(lang, 0) + len(raw)
                if size[lang] >= _TEXT_BYTES:
                    yield rows(lang, words.setdefault(lang, _Words(lang)), texts.pop(lang))
                    size[lang] = 0
            if sum(size.values()) >= 2 * _TEXT_BYTES:
                for lang in list(texts):
                    yield rows(lang, words.setdefault(lang, _Words(lang)), texts.pop(lang))
                size = {}
                words = {k: w for k, w in words.items() if len(words) <= 64}
        for lang in list(texts):
            yield rows(lang, words.setdefault(lang, _Words(lang)), texts.pop(lang))

    return run


def bloom_filter(phrases: DataFrame, count: int) -> tuple[bytes, int]:
    """A filter over ``lang, phrase`` with 16 bits or more a phrase and 2 ** 28 bits at most, put together in chunks of 2 ** 16 bits."""
    bits = min(max(math.ceil(math.log2(16 * max(count, 1))), _CHUNK_BITS), _MOST_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: dict[str, int] = {}
        for b in batches:
            at = set()
            for lang, phrase in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), strict=True):
                seed = seeds.setdefault(lang, xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))
                h = phrase_hashes([np.asarray([xxhash.xxh64_intdigest(w, seed)], np.uint64) for w in phrase.encode("utf-8", "surrogatepass").split(b" ")])
                at.update(int(p[0]) for p in probes(h, bits))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(at), pa.int64())], names=["at"])

    # a bitmap of whole longs by OR: at most 2 ** 28 / 64 rows, whatever the number of phrases
    rows = phrases.mapInArrow(places, "at bigint").groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    chunks = rows.groupBy(F.shiftright("word", _CHUNK_BITS - 6).alias("chunk")).agg(F.collect_list(F.struct("word", "bits")).alias("words"))
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    for r in chunks.toLocalIterator():
        for word, value in r["words"]:
            bitmap[word] = value
    return bitmap.tobytes(), bits


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of all phrases of up to ``max_words`` words found ``min_count`` times or more, and ``lang, n`` of all words."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.BinaryType()), T.StructField("n", T.LongType())])
    levels, total, held, bits = [], None, None, 0
    for n in range(1, max_words + 1):
        counted = rows.mapInArrow(_ngram_rows(n, held, bits), schema).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if n == 1:
            every = written(counted, "words")
            total = written(every.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
            counted = every
        level = written(counted.where(F.col("f") >= min_count).select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(n).alias("words"), "f"), "phrases")
        if n == 1:
            discard(every)
        levels.append(level)
        count = level.count()
        if not count:
            break
        if n < max_words:
            held, bits = bloom_filter(level, count)
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    counts = written(out, "counts")
    discard(*levels)
    return counts, total


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, absorbed_percent: int = 100) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of ``docs`` (``lang, text``; other columns are ignored).

    Everything is counted per language; a null lang is ``und``, a null text empty. Repeated rows count each time. A phrase goes
    if a longer one around it has ``absorbed_percent`` of its count; since counts only fall with each word added, looking one
    word further suffices. Ties in score and count are ordered by the phrase's UTF-8 bytes. An empty table gives none.
    """
    counts, total = phrase_counts(docs, min_count, max_words)
    longer = counts.where("words > 1")
    word = F.split("phrase", " ")
    around = longer.where("words > 2").select("lang", "f", F.explode(F.array_distinct(F.array(F.array_join(F.slice(word, 1, F.col("words") - 1), " "), F.array_join(F.slice(word, F.lit(2), F.col("words") - 1), " ")))).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("f").alias("f_longer"))
    free = longer.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("f_longer") < absorbed_percent * F.col("f"), F.lit(True)))
    cuts = free.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(word, F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(total, "lang")
    exact = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))")
    weakest = scored.withColumn("score", exact.cast("long")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    flat = weakest.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return flat.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
