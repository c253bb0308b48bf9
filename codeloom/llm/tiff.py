"""TIFF media columns: a walker of image directories with PackBits, LZW and deflate, strips and tiles, and predictors.

:func:`pages` emits one row for each page of each TIFF in a binary column. :func:`encode` is the matching writer; it
stores any bytes losslessly as 8-bit samples, in the layout asked for.

Defined cases: null, empty or malformed media give one row whose ``error`` says so and whose page is null; a cycle of
directories ends the walk with an error; a null doc_id is carried through; repeated rows give equal results; an empty
table gives an empty result; other columns are not read. A null text is the empty text, stored as 192 blanks. Long payloads are cut into
pages of ``ROWS`` rows of ``ROW`` bytes and are never truncated.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

ROW, ROWS = 192, 256
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Compression, predictor, samples a pixel, tiled.
LAYOUTS = ((DEFLATE, 2, 3, False), (LZW, 1, 1, True), (PACKBITS, 1, 1, False), (LZW, 2, 3, False), (DEFLATE, 1, 3, True))
STRIP, TILE = 64, 64
_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)
_BASE = [bytes([i]) for i in range(256)] + [b"", b""]


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        nonlocal at
        while at < end:
            n = min(128, end - at)
            out.append(n - 1)
            out.extend(data[at : at + n])
            at += n

    for m in _RUN.finditer(data):
        literal(m.start())
        out += bytes((257 - (m.end() - m.start()), data[m.start()]))
        at = m.end()
    literal(len(data))
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        k = data[i]
        i += 1
        if k < 128:
            out.append(data[i : i + k + 1])
            i += k + 1
        elif k > 128:
            out.append(data[i : i + 1] * (257 - k))
            i += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, with the early change of width."""
    out, acc, held, width = bytearray(), 256, 9, 9
    table: dict[int, int] = {}
    after, prefix = 258, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        if (code := table.get(key)) is not None:
            prefix = code
            continue
        acc, held = acc << width | prefix, held + width
        table[key] = after
        after += 1
        prefix = byte
        if after == 4095:
            acc, held = acc << 12 | 256, held + 12
            table.clear()
            after, width = 258, 9
        elif after in (512, 1024, 2048):
            width += 1
        if held >= 64:
            spare = held & 7
            out += (acc >> spare).to_bytes(held >> 3, "big")
            acc, held = acc & ((1 << spare) - 1), spare
    if prefix >= 0:
        acc, held, after = acc << width | prefix, held + width, after + 1
        if after in (512, 1024, 2048):
            width += 1
    acc, held = acc << width | 257, held + width
    pad = -held & 7
    return bytes(out + (acc << pad).to_bytes((held + pad) >> 3, "big"))


def lzw_decode(data: bytes) -> bytes:
    out: list[bytes] = []
    table, width, acc, held, last = _BASE.copy(), 9, 0, 0, b""
    for byte in data:
        acc, held = acc << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == 256:
            table, width, last = _BASE.copy(), 9, b""
            continue
        if code == 257:
            break
        if last:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) in (511, 1023, 2047):
                width += 1
        else:
            entry = table[code]
        out.append(entry)
        last = entry
    return b"".join(out)


def _pack(data: bytes, compression: int) -> bytes:
    if compression == LZW:
        return lzw_encode(data)
    if compression == PACKBITS:
        return packbits_encode(data)
    return zlib.compress(data, 6) if compression == DEFLATE else data


def _unpack(data: bytes, compression: int) -> bytes:
    if compression == LZW:
        return lzw_decode(data)
    if compression == PACKBITS:
        return packbits_decode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == NONE:
        return data
    raise ValueError(f"compression {compression} isn't known")


def _difference(block: np.ndarray) -> np.ndarray:
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def encode(payload: bytes, layout: tuple[int, int, int, bool] | None = None) -> bytes:
    """A little-endian TIFF of pages of at most ``ROWS`` rows of ``ROW`` bytes. The layout follows from the payload unless given."""
    compression, predictor, samples, tiled = layout or LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW // samples, samples)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for top in range(0, len(image), ROWS):
        page = image[top : top + ROWS]
        height, width = page.shape[:2]
        blocks = []
        if tiled:
            for y in range(0, height, TILE):
                for x in range(0, width, TILE):
                    tile = np.zeros((TILE, TILE, samples), np.uint8)
                    part = page[y : y + TILE, x : x + TILE]
                    tile[: part.shape[0], : part.shape[1]] = part
                    blocks.append(tile)
        else:
            blocks = [page[y : y + STRIP] for y in range(0, height, STRIP)]
        at, sizes = [], []
        for block in blocks:
            data = _pack((_difference(block) if predictor == 2 else block).tobytes(), compression)
            at.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) & 1)
        tags = {256: [width], 257: [height], 258: [8] * samples, 259: [compression], 262: [1 if samples == 1 else 2], 277: [samples], 284: [1], 317: [predictor]}
        tags |= {322: [TILE], 323: [TILE], 324: at, 325: sizes} if tiled else {278: [STRIP], 273: at, 279: sizes}
        far = {}
        for tag, values in tags.items():
            if len(values) > 1:
                far[tag] = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags))
        for tag in sorted(tags):
            out += struct.pack("<HHII", tag, 4, len(tags[tag]), far.get(tag, tags[tag][0]))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


_SIZES = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I")}


def directories(media: bytes) -> Iterator[dict[int, tuple[int, ...]]]:
    """The tags of each image directory, in order."""
    end = {b"II": "<", b"MM": ">"}.get(media[:2])
    if end is None or struct.unpack_from(end + "H", media, 2)[0] != 42:
        raise ValueError("no TIFF")
    at, seen = struct.unpack_from(end + "I", media, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the directories form a cycle")
        seen.add(at)
        (n,) = struct.unpack_from(end + "H", media, at)
        tags = {}
        for i in range(n):
            place = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(end + "HHI", media, place)
            if kind in _SIZES:
                size, letter = _SIZES[kind]
                where = place + 8 if size * count <= 4 else struct.unpack_from(end + "I", media, place + 8)[0]
                tags[tag] = struct.unpack_from(f"{end}{count}{letter}", media, where)
        yield tags
        (at,) = struct.unpack_from(end + "I", media, at + 2 + 12 * n)


def image(media: bytes, tags: dict[int, tuple[int, ...]]) -> np.ndarray:
    """The samples of one page, height x width x samples."""
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples = one(256), one(257), one(277, 1)
    if set(tags.get(258, (1,))) != {8} or one(284, 1) != 1:
        raise ValueError("only interleaved 8-bit samples are read")
    compression, predictor = one(259, 1), one(317, 1)
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} isn't known")
    out = np.zeros((height, width, samples), np.uint8)
    tiled = 322 in tags
    bw, bh = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    across = -(-width // bw)
    for k, (at, size) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279])):
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, height - y)
        block = np.frombuffer(_unpack(media[at : at + size], compression), np.uint8, rows * bw * samples).reshape(rows, bw, samples)
        if predictor == 2:
            block = np.cumsum(block, 1, dtype=np.uint8)
        out[y : y + bh, x : x + bw] = block[: height - y, : width - x]
    return out


PAGES = "doc_id long, page int, width int, height int, samples int, compression int, pixels binary, error string"


def pages(media: DataFrame) -> DataFrame:
    """One row for each page of the column ``media``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.string()]
        names = [f.split()[0] for f in PAGES.split(", ")]
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, data = [], data.as_py()
                try:
                    for page, tags in enumerate(directories(data or b"")):
                        pixels = image(data, tags)
                        rows.append((doc_id, page, pixels.shape[1], pixels.shape[0], pixels.shape[2], tags.get(259, (1,))[0], pixels.tobytes(), None))
                except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error) as e:
                    rows.append((doc_id, None, None, None, None, None, None, str(e) or type(e).__name__))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return pick(media, doc_id="doc_id", media="media").mapInArrow(run, PAGES)


def payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(1, -(-len(data) // ROW)) * ROW, b" ")


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, media``: each text as a TIFF."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(payload(t.as_py())[1]) for t in batch.column(1)], pa.binary())], names=["doc_id", "media"])

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, media binary")


def feature(rows: np.ndarray) -> str:
    """Mean and deviation of the samples in thousandths, and which cells of an 8 x 8 grid are brighter than the mean."""
    mean = rows.mean()
    edges = np.linspace(0, len(rows), 9).astype(int)
    grid = np.array([[rows[min(a, len(rows) - 1) : max(b, a + 1), 24 * x : 24 * x + 24].mean() for x in range(8)] for a, b in zip(edges, edges[1:])])
    bits = int("".join("1" if v > mean else "0" for v in grid.ravel()), 2)
    return f"{round(mean * 1000)}:{round(rows.std() * 1000)}:{bits:016x}"


def round_trip_digests(docs: DataFrame) -> DataFrame:
    """Stores each text, reads the stored bytes back page by page and describes them, all in one pass."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages long, compression int"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, data = payload(text.as_py())
                media = encode(data)
                own = list(directories(media))
                read = np.concatenate([image(media, tags).reshape(-1, ROW) for tags in own])
                back = read.tobytes()
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(read), len(own), own[0][259][0]))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=[f.split()[0] for f in fields.split(", ")])

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(run, fields)
