"""Media columns: ISO media containers, written and walked without decoding payloads."""

from __future__ import annotations

import struct
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_columns

#: Bytes of a frame: 8 by 8 grey samples of 8 bits.
FRAME = 64
#: Every so many frames one counts as a key frame; frames of a second.
KEY_EVERY, RATE = 64, 25
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"mvex", b"moof", b"traf"}

#: Tables that a track must have, besides the offsets of its chunks.
TABLES = {b"stsd", b"stts", b"stsc", b"stsz"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >> 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the frame size."""
    return data + bytes(max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def write_container(payload: bytes) -> bytes:
    """An ISO container whose one track holds the payload as uncompressed grey frames."""
    frames, odd = divmod(len(payload), FRAME)
    if odd or not frames:
        raise ValueError("the payload must be a positive multiple of the frame size")
    unity = struct.pack(">9i", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)
    head = box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ")
    keys = range(1, frames + 1, KEY_EVERY)
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIIIHHIIIH32sHh", 1, 0, 0, 0, 0, 0, 8, 8, 72 << 16, 72 << 16, 0, 1, b"", 40, -1))
    tables = [full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, frames, 1)), full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)), full(b"stsc", struct.pack(">IIII", 1, 1, frames, 1)), full(b"stsz", struct.pack(">II", FRAME, frames))]

    def moov(at: int) -> bytes:
        chunks = full(b"co64", struct.pack(">IQ", 1, at))
        info = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), box(b"stbl", *tables, chunks))
        media = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)), full(b"hdlr", struct.pack(">4s4s12s", b"mhlr", b"vide", b""), b"\0"), info)
        track = box(b"trak", full(b"tkhd", struct.pack(">IIIIIQhhhH", 0, 0, 1, 0, frames, 0, 0, 0, 0, 0), unity, struct.pack(">II", 8 << 16, 8 << 16), flags=3), media)
        return box(b"moov", full(b"mvhd", struct.pack(">IIIIIh10s", 0, 0, RATE, frames, 65536, 256, b""), unity, bytes(24), struct.pack(">I", 2)), track)

    start = len(head) + len(moov(0)) + (16 if len(payload) + 8 >> 32 else 8)
    return head + moov(start) + box(b"mdat", payload)


#: Boxes within boxes that are entered; real files nest seven or eight deep.
DEEPEST = 32


def walk(data: bytes):
    """(path, body start, body end) of each box, parents first; a box that leaves its parent ends the walk of that parent. Boxes nested deeper than ``DEEPEST`` are told, but not entered."""
    open_boxes = [((), 0, len(data))]
    while open_boxes:
        path, start, end = open_boxes.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and body + 8 <= end:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        size = size or end - start
        if start + size > end or start + size < body:
            continue
        yield (*path, kind), body, start + size
        open_boxes.append((path, start + size, end))
        if kind in NESTED and len(path) < DEEPEST:
            open_boxes.append(((*path, kind), body, start + size))


def _table(data: bytes, at: int, form: str) -> np.ndarray:
    """Rows of a sample table of 32-bit (I) or 64-bit (Q) numbers."""
    (n,) = struct.unpack_from(">I", data, at + 4)
    step = struct.calcsize(">" + form)
    if at + 8 + n * step > len(data):
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, ">u4" if form[0] == "I" else ">u8", n * len(form), at + 8).astype(np.int64).reshape(n, len(form))


def sample_places(chunks: np.ndarray, runs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where each sample begins: a chunk holds as many samples as its run tells, one behind the other."""
    first = runs[:, 0] - 1
    if not len(runs) or first[0] != 0 or (np.diff(first) <= 0).any() or first[-1] >= max(len(chunks), 1):
        raise ValueError("chunk runs are out of order")
    each = np.repeat(runs[:, 1], np.diff(np.r_[first, len(chunks)]))
    ends = np.minimum(np.cumsum(np.minimum(each, len(sizes))), len(sizes))
    counts = np.diff(np.r_[0, ends])
    before = np.cumsum(sizes) - sizes
    begin = before[np.minimum(ends - counts, max(len(sizes) - 1, 0))] if len(sizes) else np.zeros(len(chunks), np.int64)
    return np.repeat(chunks - begin, counts) + before[: int(ends[-1]) if len(ends) else 0]


def describe(data: bytes) -> dict | None:
    """Codec, duration in seconds, frames, and (offset, length) of key frames and of all frames of the first track that has sample tables; None for anything else.

    Also None: tables that are cut off, more frames than the file has bytes, frames that lie
    outside of the file or that no chunk holds, and key frames that aren't frames of the track.
    """
    found: dict[bytes, int] = {}
    try:
        for path, at, _ in walk(data):
            if path[:2] == (b"moov", b"trak"):
                if path == (b"moov", b"trak"):
                    if TABLES <= found.keys():
                        break
                    found = {}
                found.setdefault(path[-1], at)
        if not TABLES <= found.keys() or not found.keys() & {b"co64", b"stco"}:
            return None
        codec = data[found[b"stsd"] + 12 : found[b"stsd"] + 16].decode("latin-1")
        version = data[found[b"mdhd"]]
        (rate,) = struct.unpack_from(">I", data, found[b"mdhd"] + (20 if version == 1 else 12))
        times = _table(data, found[b"stts"], "II").astype(float)
        duration = float((times[:, 0] * times[:, 1]).sum()) / rate if rate else 0.0
        one, frames = struct.unpack_from(">II", data, found[b"stsz"] + 4)
        if frames > len(data):
            return None
        sizes = np.full(frames, one, np.int64) if one else _table(data, found[b"stsz"] + 4, "I")[:, 0]
        chunks = (_table(data, found[b"co64"], "Q") if b"co64" in found else _table(data, found[b"stco"], "I"))[:, 0]
        places = sample_places(chunks, _table(data, found[b"stsc"], "III"), sizes)
        if len(places) != frames or (places < 0).any() or (places > len(data) - sizes).any():
            return None
        keys = _table(data, found[b"stss"], "I")[:, 0] - 1 if b"stss" in found else np.arange(frames)
        if len(keys) and (keys.min() < 0 or keys.max() >= frames):
            return None
        ranges = list(zip(places[keys].tolist(), sizes[keys].tolist(), strict=True))
        return {"codec": codec, "duration": duration, "frames": frames, "keys": ranges, "places": places.tolist(), "sizes": sizes.tolist()}
    except (struct.error, ValueError, IndexError, KeyError):
        return None


def read_payload(data: bytes, told: dict) -> bytes:
    """The stored frames, joined; neighbours are read together."""
    places, sizes = (np.array(told[k], np.int64) for k in ("places", "sizes"))
    if not len(places):
        return b""
    ends = places + sizes
    first = np.flatnonzero(np.r_[True, places[1:] != ends[:-1]])
    last = np.r_[first[1:], len(places)] - 1
    return b"".join(data[a:b] for a, b in zip(places[first].tolist(), ends[last].tolist(), strict=True))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's padded UTF-8 bytes in an ISO container, as column ``media``; ``n_bytes`` are the unpadded ones.

    Null texts count as empty, which is one frame of zeros. One row for each input row, with
    repeated rows and null ids as they are; other columns are ignored. No shuffle.
    """

    def run(ids: pa.Array, texts: pa.Array) -> dict:
        raw = [(t or "").encode() for t in texts.to_pylist()]
        return {"id": ids, "n_bytes": pa.array([len(x) for x in raw], pa.int64()), "media": pa.array([write_container(pad(x)) for x in raw], pa.binary())}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs.select(id_col, text_col), run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def inspect(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", payload_digests: bool = False) -> DataFrame:
    """Codec, duration, frames and key frames' byte ranges of containers, from their boxes alone.

    Bytes that aren't a container with sound sample tables, and nulls: null features. With
    ``payload_digests`` also the stored frames' size, SHA-256 and CRC-32 of the last 64 bytes.
    Repeated rows and null ids: a row each. Of other columns only ``n_bytes`` is taken over, where
    it is there. An empty table gives no rows.
    """
    told_size = F.col("n_bytes").cast("long") if "n_bytes" in media.columns else F.lit(None).cast("long")

    def run(ids: pa.Array, sizes: pa.Array, datas: pa.Array) -> dict:
        rows = []
        for value in datas:
            data = value.as_py()
            told = describe(data) if data is not None else None
            row = {"codec": None, "duration": None, "frames": None, "keyframes": None, "media_bytes": None if data is None else len(data), "media_sha256": None if data is None else sha256(data).hexdigest(), "payload_bytes": None, "payload_sha256": None, "tail_crc32": None}
            if told:
                row |= {k: told[k] for k in ("codec", "duration", "frames")} | {"keyframes": [{"offset": a, "length": n} for a, n in told["keys"]]}
                if payload_digests:
                    payload = read_payload(data, told)
                    row |= {"payload_bytes": len(payload), "payload_sha256": sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:])}
            rows.append(row)
        ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
        kinds = {"codec": pa.string(), "duration": pa.float64(), "frames": pa.int64(), "keyframes": ranges, "media_bytes": pa.int64(), "media_sha256": pa.string(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64()}
        return {"id": ids, "n_bytes": sizes} | {k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()}

    kind = media.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, codec string, duration double, frames long, keyframes array<struct<offset: bigint, length: bigint>>, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long"
    return map_columns(media.select(id_col, told_size, media_col), run, schema).withColumnRenamed("id", id_col)
