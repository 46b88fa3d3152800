"""Media columns: AVI files of motion-JPEG frames, their RIFF indexes, intra frames, and shots by adaptive histogram differences."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The zigzag order of an 8 x 8 JPEG block.
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]
#: Frames a second and 8 x 8 blocks in a frame of stored payloads (64 x 64 samples).
FPS, FRAME_BLOCKS = 10, 64
CLIP = "clip int, first_frame int, n_frames int, start_s double, end_s double, error string"
#: What a file that is not whole raises while it is read.
DAMAGED = (ValueError, IndexError, KeyError, struct.error)


def _idct_matrix() -> np.ndarray:
    """Coefficients in zigzag order to samples, as one 64 x 64 matrix."""
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


IDCT = _idct_matrix()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_frame(payload: np.ndarray) -> bytes:
    """A grey baseline JPEG whose quantised coefficients carry ``payload`` (blocks x 64, uint8) without loss.

    Byte b is the coefficient of eight bits whose amplitude bits are b, quantised by 1; each Huffman table has one
    symbol (no zeros before, eight bits) of code length 8, and a restart after every block clears the DC prediction.
    """
    n = len(payload)
    wide = 8 if n % 8 == 0 else 1
    data = np.zeros((n, 130), np.uint8)
    data[:, 1:128:2] = payload
    data[:, 128] = 0xFF
    data[:, 129] = 0xD0 + np.arange(n) % 8
    if (payload == 0xFF).any():
        scan = b"".join(bytes(x[:128]).replace(b"\xff", b"\xff\x00") + bytes(x[128:]) for x in data)[:-2]
    else:
        scan = data.tobytes()[:-2]
    table = bytes([0] * 7 + [1] + [0] * 8 + [8])
    head = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * (n // wide), 8 * wide, 1, 1, 0x11, 0))
    return b"\xff\xd8" + head + _segment(0xC4, b"\0" + table + b"\x10" + table) + _segment(0xDD, b"\0\1") + _segment(0xDA, b"\1\1\0\0\x3f\0") + scan + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def mux(frames: list[bytes], wide: int, high: int, fps: int = FPS, comment: bytes = b"") -> bytes:
    """An AVI file of one video stream, all frames ``wide`` by ``high``, with an index of its frames and a comment."""
    n, most = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, n, 0, 1, most, wide, high, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, fps, 0, n, most, 0xFFFFFFFF, 0, 0, 0, wide, high)
    strf = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 24, b"MJPG", wide * high * 3, 0, 0, 0, 0)
    header = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", comment)) if comment else b""
    body = b"AVI " + _chunk(b"LIST", header) + info + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def demux(avi: bytes) -> tuple[list[bytes], float, bytes]:
    """The video frames that the index names (else those of the movi list, in turn), the frames a second, and the comment.

    ValueError if the file is no AVI file or is cut off.
    """
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    if struct.unpack_from("<I", avi, 4)[0] + 8 > len(avi):
        raise ValueError("cut off")
    fps, index, movi, at, comment = 25.0, [], 0, 12, b""
    walked: list[tuple[int, int]] = []
    while at + 8 <= len(avi):
        name, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if name == b"LIST":
            if avi[at + 8 : at + 12] == b"movi":
                movi = at + 8
            at += 12
            continue
        if name == b"strh" and avi[at + 8 : at + 12] == b"vids":
            scale, rate = struct.unpack_from("<II", avi, at + 28)
            fps = rate / scale if scale else fps
        elif name == b"ICMT":
            comment = avi[at + 8 : at + 8 + size]
        elif name == b"idx1":
            index = [x[2:] for x in struct.iter_unpack("<4sIII", avi[at + 8 : at + 8 + size - size % 16]) if x[0][2:] in (b"dc", b"db")]
        elif name[2:] in (b"dc", b"db"):
            walked.append((at + 8, size))
        at += 8 + size + size % 2
    if index and movi:
        base = movi if index[0][0] < movi else 0  # offsets count from the list's name, or from the file's start
        walked = [(base + o + 8, n) for o, n in index]
    if any(a + n > len(avi) for a, n in walked):
        raise ValueError("a frame lies outside the file")
    return [avi[a : a + n] for a, n in walked], fps, comment


class _Huffman(dict):
    """(code length, code) to symbol."""

    def __init__(self, counts: bytes, symbols: bytes):
        code, k = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1


def decode_frame(jpeg: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and quantisers (blocks x 64 in zigzag order, 64) of the first component of a baseline JPEG."""
    at, quant, tables, every, parts = 2, {}, {}, 0, []
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.float32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            high, wide, n = struct.unpack_from(">HHB", body, 1)
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif marker in (0xC2, 0xC3, 0xC5, 0xC6, 0xC7):
            raise ValueError("only baseline frames are read")
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            ids = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            break
    scan = jpeg[at : jpeg.rindex(b"\xff\xd9")]
    single = len(parts) == 1
    across = -(-wide // (8 * (1 if single else max(p[1] for p in parts))))
    down = -(-high // (8 * (1 if single else max(p[2] for p in parts))))
    q = quant[parts[0][3]]
    flat = {(8, 0): 8}
    if single and every == 1 and len(scan) >= 130 * across * down - 2 and all(tables[k] == flat for k in (ids[parts[0][0]] >> 4, 16 | (ids[parts[0][0]] & 15))):
        return _decode_flat(scan, across * down), q
    return _decode_general(scan, across * down, every, parts, ids, tables, single), q


def _decode_flat(scan: bytes, n: int) -> np.ndarray:
    """Blocks whose every coefficient is one code of eight zero bits and eight amplitude bits, with a restart after each."""
    data = np.frombuffer(scan + b"\xff\xd0", np.uint8)
    data = np.delete(data, np.flatnonzero((data[:-1] == 0xFF) & (data[1:] == 0)) + 1)  # stuffed zero bytes stand after each 0xFF of the data
    if len(data) != 130 * n:
        raise ValueError("damaged scan")
    data = data.reshape(n, 130)
    if data[:, 0:128:2].any() or (data[:, 128] != 0xFF).any():
        raise ValueError("damaged scan")
    bits = data[:, 1:128:2].astype(np.int16)
    return np.where(bits >= 128, bits, bits - 255)


def _decode_general(scan: bytes, units: int, every: int, parts: list, ids: dict, tables: dict, single: bool) -> np.ndarray:
    """Huffman decoding by code length, one symbol after another, of all components; the first one's blocks are kept."""
    runs, start = [], 0
    for k in range(len(scan) - 1):
        if scan[k] == 0xFF and 0xD0 <= scan[k + 1] <= 0xD7:
            runs.append(scan[start:k])
            start = k + 2
    runs.append(scan[start:])
    out = []
    for r, run in enumerate(runs):
        bits = np.unpackbits(np.frombuffer(run.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        at, last = 0, {p[0]: 0 for p in parts}

        def take(n: int) -> int:
            nonlocal at
            v = 0
            for b in bits[at : at + n]:
                v = v << 1 | b
            at += n
            return v

        def symbol(t: _Huffman) -> int:
            code = 0
            for length in range(1, 17):
                code = code << 1 | take(1)
                if (length, code) in t:
                    return t[length, code]
            raise ValueError("damaged scan")

        def amplitude(n: int) -> int:
            v = take(n)
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        for _ in range(min(every, units - r * every) if every else units):
            for p in parts:
                for _ in range(1 if single else p[1] * p[2]):
                    block, k = [0] * 64, 1
                    last[p[0]] += amplitude(symbol(tables[ids[p[0]] >> 4]))
                    block[0] = last[p[0]]
                    while k < 64:
                        s = symbol(tables[16 | (ids[p[0]] & 15)])
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15 and k < 64:
                            block[k] = amplitude(s & 15)
                        k += 1
                    if p is parts[0]:
                        out.append(block)
    return np.asarray(out, np.int16).reshape(-1, 64)


def histograms(blocks: np.ndarray, frame_of: np.ndarray, n_frames: int, bins: int = 32) -> np.ndarray:
    """Shares of the samples of each frame in equal brightness bins; ``blocks`` holds dequantised coefficients."""
    samples = np.clip(np.rint(blocks.astype(np.float32) @ IDCT + 128), 0, 255).astype(np.int64)
    cells = (samples * bins >> 8) + frame_of[:, None] * bins
    h = np.bincount(cells.ravel(), minlength=n_frames * bins).reshape(n_frames, bins).astype(float)
    return h / np.maximum(h.sum(1, keepdims=True), 1)


def shots(hist: np.ndarray, back: int = 8, factor: float = 2.0, floor: float = 0.08) -> list[int]:
    """First frames of shots: a cut stands where half the difference of two frames' histograms exceeds the floor and
    ``factor`` times the mean of up to ``back`` differences since the last cut."""
    cuts, gaps = [0] if len(hist) else [], []
    for k, d in enumerate((np.abs(np.diff(hist, axis=0)).sum(1) / 2).tolist(), 1):
        if d > max(floor, factor * (sum(gaps[-back:]) / len(gaps[-back:]) if gaps else floor)):
            cuts.append(k)
            gaps = []
        else:
            gaps.append(d)
    return cuts


def clips(avi: bytes) -> tuple[np.ndarray, list[tuple[int, int, int, float, float]]]:
    """The coefficients of all blocks (x 64), without those that fill up the last frame, and the timed clips (number, first
    frame, frames, start and end in seconds). One of DAMAGED if the file or a frame isn't whole."""
    frames, fps, comment = demux(avi)
    decoded = [decode_frame(f) for f in frames]
    if not decoded:
        return np.zeros((0, 64), np.int16), []
    coded = np.concatenate([d[0] for d in decoded])
    frame_of = np.repeat(np.arange(len(decoded)), [len(d[0]) for d in decoded])
    scaled = np.concatenate([d[0] * d[1] for d in decoded])
    cuts = shots(histograms(scaled, frame_of, len(decoded)))
    ends = [*cuts[1:], len(decoded)]
    held = int(comment[7:]) if comment.startswith(b"blocks=") else len(coded)
    return coded[:held], [(k, a, b - a, a / fps, b / fps) for k, (a, b) in enumerate(zip(cuts, ends, strict=True))]


def pack_bytes(data: bytes) -> tuple[bytes, int]:
    """An AVI file that carries ``data`` and zero bytes up to a positive multiple of 64, and the padded length.

    All frames have one size, FRAME_BLOCKS blocks at most; zero blocks fill up the last one, and the comment says how many
    blocks are the payload's.
    """
    padded = data + b"\0" * (-len(data) % 64 if data else 64)
    n = len(padded) // 64
    each = -(-n // -(-n // FRAME_BLOCKS))
    blocks = np.frombuffer(padded + b"\0" * (64 * (-n % each)), np.uint8).reshape(-1, 64)
    wide = 8 if each % 8 == 0 else 1
    frames = [encode_frame(blocks[k : k + each]) for k in range(0, len(blocks), each)]
    return mux(frames, 8 * wide, 8 * (each // wide), comment=b"blocks=%d" % n), len(padded)


def to_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text's UTF-8 bytes as an AVI file; a null text is empty, other columns are ignored."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                b = batch.slice(k, 500)
                data = [x or b"" for x in b.column("data").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(map(len, data)), pa.int64()), pa.array([pack_bytes(x)[0] for x in data], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data")).mapInArrow(encode, "doc_id bigint, n_bytes bigint, media binary")


def media_clips(media: DataFrame) -> DataFrame:
    """A row for each timed clip of each AVI file: doc_id and the columns of CLIP.

    A whole file without frames has none; null media are skipped; a file that can't be read to its end has one row, whose
    ``error`` says why and whose other columns are null.
    """

    def timed(m: bytes) -> list[tuple]:
        try:
            return [(*c, None) for c in clips(m)[1]]
        except DAMAGED as e:
            return [(None, None, None, None, None, str(e))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *c) for i, m in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True) if m is not None for c in timed(m)]
            names = ["doc_id", "clip", "first_frame", "n_frames", "start_s", "end_s", "error"]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return media.select("doc_id", "media").mapInArrow(cut, f"doc_id bigint, {CLIP}")


def file_digest(m: bytes | None) -> tuple:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of one stored file.

    All null for a null file. A file that can't be read to its end has no payload (nulls) and the feature "damaged"; a whole
    file without frames has an empty payload.
    """
    if m is None:
        return (None,) * 6
    stored = len(m), hashlib.sha256(m).hexdigest()
    try:
        coded, found = clips(m)
    except DAMAGED:
        return None, None, None, *stored, "damaged"
    payload = np.where(coded >= 0, coded, coded + 255).astype(np.uint8).tobytes()
    frames = found[-1][1] + found[-1][2] if found else 0
    feature = f"frames={frames};shots={len(found)};" + ",".join(f"{c[3]:.1f}-{c[4]:.1f}" for c in found)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, feature


def media_digests(media: DataFrame) -> DataFrame:
    """What is read back from each stored file: payload and file digests, and the clips as one string (``file_digest``)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                b = batch.slice(k, 500)
                rows = list(map(file_digest, b.column("media").to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(digest, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
