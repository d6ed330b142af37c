"""TIFF media columns: write bytes as 8-bit samples, walk a file's directories, and give one row a page.

Read: either byte order, chained directories, strips and tiles, no compression, LZW, deflate and PackBits, the
horizontal predictor, 8-bit chunky samples. Written: little-endian pages of any of these. What else a file may hold
(planes apart, other predictors, sample sizes and bit orders) is refused, not guessed.

A null media value has no pages. A file that can't be read, or from its bad page on, gives one row with its error and no
pixels; a chain that comes back to a directory ends there. Nothing is allocated before the file could hold it: a page has
at most LIMIT bytes and no more than its compression can make of its strips, and decoders stop at a strip's size.
Repeated rows give repeated pages; an empty table gives none. Very long texts make one large page each, in a batch of its
own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns, slices

#: Tags of the format.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANES, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 256, 257, 258, 259, 262, 266, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
#: Compression codes of the format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Field types of the format (struct code and size).
TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}

#: Bytes that a byte of a strip can become at most, by compression.
RATIO = {NONE: 1, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032, PACKBITS: 64}
#: Bytes of a page's samples that are read at most, and of pages that are held at once.
LIMIT, HELD = 1 << 30, 1 << 26

#: What a payload is padded to a multiple of: a row of 64 pixels of three samples.
UNIT = 192


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            out += bytes((257 - (j - i), data[i]))
            i = j
            continue
        j = i
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += k + 2
        else:
            if k > 128:
                out += data[i + 1 : i + 2] * (257 - k)
            i += 2 if k > 128 else 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    bits, held, out = 0, 0, bytearray()
    table: dict[bytes, int] = {}
    width = 9

    def put(code: int) -> None:
        nonlocal bits, held
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    size, word = 258, b""
    for x in data:
        longer = word + bytes((x,))
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(table[word] if len(word) > 1 else word[0])
        table[longer] = size
        size += 1
        if size == 4094:
            put(256)
            table.clear()
            size, width = 258, 9
        elif size + 1 > 1 << width:
            width += 1
        word = longer[-1:]
    if word:
        put(table[word] if len(word) > 1 else word[0])
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out = bytearray()
    table: list[bytes] = []
    width, bits, held, before = 9, 0, 0, b""
    for x in data:
        held = held << 8 | x
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table = [bytes((k,)) for k in range(256)] + [b"", b""]
            width, before = 9, b""
            continue
        if not before:
            got = table[code]
        else:
            got = table[code] if code < len(table) else before + before[:1]
            table.append(before + got[:1])
        out += got
        before = got
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: packbits_encode}


def inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, size)


#: From a strip and the size of its samples.
DECODE = {NONE: lambda data, size: data[:size], LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: packbits_decode}


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 256, tile: int = 0) -> bytes:
    """pages: uint8 [length, width, samples]. tile: side of square tiles (a multiple of 16), 0 for strips of ``rows`` rows."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for page in pages:
        length, width, samples = page.shape
        if tile:
            grid = np.zeros((-(-length // tile) * tile, -(-width // tile) * tile, samples), np.uint8)
            grid[:length, :width] = page
            parts = [grid[y : y + tile, x : x + tile] for y in range(0, len(grid), tile) for x in range(0, grid.shape[1], tile)]
        else:
            parts = [page[y : y + rows] for y in range(0, length, rows)]
        places, counts = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            coded = ENCODE[compression](part.tobytes())
            places.append(len(out))
            counts.append(len(coded))
            out += coded + b"\0" * (len(coded) % 2)
        bits = [8] * samples
        fields = [(WIDTH, 4, [width]), (LENGTH, 4, [length]), (BITS, 3, bits), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tile]), (TILE_LENGTH, 4, [tile]), (TILE_OFFSETS, 4, places), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, places), (ROWS_PER_STRIP, 4, [rows]), (STRIP_COUNTS, 4, counts)]
        entries = []
        for tag, kind, values in sorted(fields):
            code, size = TYPES[kind]
            raw = struct.pack(f"<{len(values)}{code}", *values)
            if len(raw) > 4:
                entries.append(struct.pack("<HHII", tag, kind, len(values), len(out)))
                out += raw + b"\0" * (len(raw) % 2)
            else:
                entries.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple[int, ...]]]]:
    """Byte order and fields of each directory of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(f"{order}H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(f"{order}I", data[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(f"{order}H", data, at)
        fields = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            if kind in TYPES:
                code, size = TYPES[kind]
                place = at + 10 + 12 * k
                if count * size > 4:
                    (place,) = struct.unpack_from(f"{order}I", data, place)
                fields[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
        yield order, fields
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)


def read_page(data: bytes, fields: dict[int, tuple[int, ...]]) -> np.ndarray:
    """uint8 [length, width, samples]; raises ValueError or KeyError for what isn't read."""
    width, length, samples = fields[WIDTH][0], fields[LENGTH][0], fields.get(SAMPLES, (1,))[0]
    if not width or not length or not samples:
        raise ValueError("a page without samples")
    if set(fields.get(BITS, (1,))) != {8}:
        raise ValueError("samples aren't 8 bits")
    if samples > 1 and fields.get(PLANES, (1,))[0] != 1:
        raise ValueError("planes are apart")
    if fields.get(FILL_ORDER, (1,))[0] != 1:
        raise ValueError("bits are in another order")
    compression, predictor = fields.get(COMPRESSION, (NONE,))[0], fields.get(PREDICTOR, (1,))[0]
    if compression not in DECODE or predictor not in (1, 2):
        raise ValueError(f"compression {compression} with predictor {predictor}")
    tiled = TILE_OFFSETS in fields
    places, counts = fields[TILE_OFFSETS if tiled else STRIP_OFFSETS], fields[TILE_COUNTS if tiled else STRIP_COUNTS]
    wide, high = (fields[TILE_WIDTH][0], fields[TILE_LENGTH][0]) if tiled else (width, min(fields.get(ROWS_PER_STRIP, (length,))[0], length))
    if not wide or not high:
        raise ValueError("strips or tiles without samples")
    across, down = -(-width // wide), -(-length // high)
    if not len(places) == len(counts) == across * down:
        raise ValueError("another number of strips or tiles than the page has")
    if max(width * length, wide * high) * samples > min(LIMIT, RATIO[compression] * sum(min(n, len(data)) for n in counts)):
        raise ValueError("more samples than the file can hold")
    out = np.zeros((length, width, samples), np.uint8)
    for k, (at, n) in enumerate(zip(places, counts, strict=True)):
        y, x = k // across * high, k % across * wide
        rows = high if tiled else min(high, length - y)
        part = np.frombuffer(DECODE[compression](data[at : at + n], rows * wide * samples), np.uint8, rows * wide * samples).reshape(rows, wide, samples)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        out[y : y + rows, x : x + wide] = part[: length - y, : width - x]
    return out


def feature(page: np.ndarray) -> str:
    """Width, length, samples, mean, deviation and the shares of eight ranges of values."""
    counts = np.bincount(page.reshape(-1), minlength=256)
    values, n = np.arange(256), counts.sum()
    mean = float((counts * values).sum() / n)
    spread = float(((counts * (values - mean) ** 2).sum() / n) ** 0.5)
    shares = ",".join(f"{x / n:.4f}" for x in counts.reshape(8, 32).sum(1))
    return f"{page.shape[1]}x{page.shape[0]}x{page.shape[2]};{mean:.4f};{spread:.4f};{shares}"


def payload(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT or (0 if text else UNIT))


def encode_media(docs: DataFrame, compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """doc_id, n_bytes (of the text) and media: the padded text as the samples of a one-page TIFF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            media = [write_tiff([np.frombuffer(payload(t), np.uint8).reshape(-1, UNIT // 3, 3)], compression, predictor) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


PAGES = "doc_id long, n_bytes long, page int, width int, length int, samples int, pixels binary, media_bytes long, media_sha256 string, feature string, error string"


def decode_media(media: DataFrame) -> DataFrame:
    """One row a page of doc_id, n_bytes, media: its samples, the file's length and SHA-256, a feature, or an error."""
    names = [x.split()[0] for x in PAGES.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([pa.field(a, kinds[b]) for a, b in (x.split() for x in PAGES.split(", "))])

    def pages(doc_id: int | None, n: int | None, data: bytes) -> Iterator[tuple]:
        about = (len(data), hashlib.sha256(data).hexdigest())
        try:
            for k, (_, fields) in enumerate(directories(data)):
                page = read_page(data, fields)
                yield (doc_id, n, k, page.shape[1], page.shape[0], page.shape[2], page.tobytes(), *about, feature(page), None)
        except (ValueError, KeyError, IndexError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
            yield (doc_id, n, None, None, None, None, None, *about, None, str(e) or type(e).__name__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows, held = [], 0
            for doc_id, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                for row in pages(doc_id, n, data) if data is not None else ():
                    rows.append(dict(zip(names, row, strict=True)))
                    held += len(row[6] or b"")
                    if held > HELD:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return columns(media, "doc_id", "n_bytes", "media").mapInArrow(run, PAGES)
