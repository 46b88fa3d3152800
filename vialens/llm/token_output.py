"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on the document ids."""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKEN_SCHEMA = "part int, doc_id bigint, part_start bigint, ids array<int>"
#: Words that a worker keeps with their ids; words met later are encoded each time.
KEPT_WORDS = 600_000
_tokenizers: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """The tokenizer of a file, its kept words, and which ids end a word (none if it doesn't say so); a worker loads it once."""
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task a core already
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        suffix = getattr(t.model, "end_of_word_suffix", None)
        closes = np.zeros(t.get_vocab_size() if suffix else 0, bool)
        if suffix:
            closes[[i for w, i in t.get_vocab().items() if w.endswith(suffix) and i < len(closes)]] = True
        _tokenizers[path] = (t, {}, closes)
    return _tokenizers[path]


def _encode_words(words: list[str], path: str, together: int = 2000) -> Iterator[tuple[str, bytes]]:
    """Each word with its ids. Words of letters alone are encoded many at once and parted after the ids that end a word;
    where these are not as many as the words, and for all other words, each is encoded by itself."""
    tokenizer, _, closes = _tokenizer(path)
    plain = [w for w in words if w.isalpha()] if len(closes) else []
    alone = [w for w in words if not w.isalpha()] if len(closes) else words
    groups = [plain[k : k + together] for k in range(0, len(plain), together)]
    for group, e in zip(groups, tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
        ids = np.asarray(e.ids, "<i4")
        cuts = ((np.flatnonzero(closes[ids]) + 1) * 4).tolist()
        if len(cuts) != len(group):
            alone += group
            continue
        data = ids.tobytes()
        yield from zip(group, map(data.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True)
    for w, e in zip(alone, tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
        yield w, np.asarray(e.ids, "<i4").tobytes()


def encode_batch(texts: list[str] | pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in turn, and each text's number of ids.

    The tokenizer drops white space and never joins characters across it, so a text's ids are those of its words in
    turn: the batch's distinct words are encoded by the library, and placed by numpy. (A test holds this against encoding
    of whole texts.)
    """
    kept = _tokenizer(path)[1]
    words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    found = list(map(kept.get, distinct))
    coded_new = dict(_encode_words([w for w, x in zip(distinct, found, strict=True) if x is None], path))
    found = [coded_new[w] if x is None else x for w, x in zip(distinct, found, strict=True)]
    kept.update(itertools.islice(coded_new.items(), max(0, KEPT_WORDS - len(kept))))
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    start = np.cumsum(size) - size
    pool = np.frombuffer(b"".join(found), "<i4")
    at = coded.indices.to_numpy(zero_copy_only=False)
    each = size[at]
    ends = np.concatenate([[0], np.cumsum(each)])
    ids = pool[np.repeat(start[at] - ends[:-1], each) + np.arange(ends[-1])]
    last = np.concatenate([[0], np.cumsum(counts)])
    return ids, np.diff(ends[last])


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian 32-bit integers."""
    ids, sizes = encode_batch(texts, path)
    ends = np.cumsum(sizes)
    return [ids[i:j].tobytes() for i, j in zip(ends - sizes, ends, strict=True)]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_mb: int = 16, index_stride: int = 1000) -> None:
    """Writes the ids of every whole text, with ``end_id`` after each, as ORC files in ascending ``doc_id`` order.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. A null text counts as empty (its one id is the end
    id), a null ``doc_id`` comes first, equal ids stand in the order of their texts' hashes, repeated rows are each
    written, and an empty table gives files without rows. Each row holds the number of its file, its start in that file
    and its ids; stripes can be read in parallel, and ``doc_id`` filters use the row indexes and Bloom filters.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                b = batch.slice(k, 2000)
                coded, sizes = encode_batch(b.column("text"), tokenizer)
                coded = np.insert(coded, np.cumsum(sizes), end_id)
                ends = np.concatenate([[0], np.cumsum(sizes + 1)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(coded, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), b.column("doc_id"), pa.array(ends[:-1] + at), ids], names=["part", "doc_id", "part_start", "ids"])
                at += int(ends[-1])

    options = {"orc.stripe.size": str(stripe_mb << 20), "orc.row.index.stride": str(index_stride), "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
    rows.mapInArrow(encode, TOKEN_SCHEMA).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of written token files with ``start``, the number of ids before the document in all files."""
    rows = spark.read.schema(TOKEN_SCHEMA).orc(path)
    ends = rows.groupBy("part").agg(F.max(F.col("part_start") + F.size("ids")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("head"))  # a row a file
    return rows.join(F.broadcast(heads), "part").select("doc_id", (F.col("part_start") + F.col("head")).cast("long").alias("start"), "ids")


def lookup_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of some documents; the files' statistics and Bloom filters prune the stripes and row groups read."""
    return spark.read.schema(TOKEN_SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def token_digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows with ``doc_id, start, ids``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            cuts = ids.offsets.to_numpy() * 4
            crc = [zlib.crc32(values[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(cuts) // 4, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
