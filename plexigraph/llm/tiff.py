"""TIFF media columns: encode byte payloads as pages, walk and decode any page.

The decoder follows the image file directories of a classic TIFF of either byte
order, decodes strips or tiles (stored, PackBits, LZW or deflate) of 1, 2, 4, 8, 16, 32 or 64 bits a
sample, undoes predictors 2 (horizontal) and 3 (floating point), and yields one page for each
directory.  What a file claims is checked against its size before memory is taken.  The DataFrame operators stream Arrow batches: what is in memory is one batch
and one document.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import column, raw_texts

#: TIFF 6.0 values (fixed).
TAG_WIDTH, TAG_HEIGHT, TAG_BITS, TAG_COMPRESSION, TAG_PHOTOMETRIC = 256, 257, 258, 259, 262
TAG_STRIPS, TAG_SAMPLES, TAG_STRIP_ROWS, TAG_STRIP_SIZES, TAG_PLANAR = 273, 277, 278, 279, 284
TAG_PREDICTOR, TAG_TILE_WIDTH, TAG_TILE_HEIGHT, TAG_TILES, TAG_TILE_SIZES, TAG_FORMAT = 317, 322, 323, 324, 325, 339
STORED, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
KINDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8)}

#: Most bytes of one page's pixels.
LARGEST = 1 << 30

#: Payloads fill up to a positive multiple of this many bytes, with this byte.
UNIT, FILL = 576, 255


class TiffError(ValueError):
    """A file that is not a TIFF this decoder can read."""


# -- codecs ------------------------------------------------------------------


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, all else as literals of at most 128."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    starts = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]))
    sizes = np.diff(starts)
    out, at = bytearray(), 0

    def literal(to: int) -> None:
        nonlocal at
        while at < to:
            k = min(128, to - at)
            out.append(k - 1)
            out.extend(data[at : at + k])
            at += k

    for i in np.flatnonzero(sizes >= 3):
        literal(int(starts[i]))
        left = int(sizes[i])
        while left >= 2:
            k = min(128, left)
            out.extend((257 - k, data[at]))
            at, left = at + k, left - k
    literal(len(a))
    return bytes(out)


def packbits_decode(data: bytes, need: int | None = None) -> bytes:
    """All of it, or as soon as ``need`` bytes are there."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and (need is None or len(out) < need):
        k = data[i]
        if k < 128:
            if i + 2 + k > n:
                raise TiffError("PackBits literal runs past its end")
            out += data[i + 1 : i + 2 + k]
            i += 2 + k
        elif k == 128:
            i += 1
        else:
            if i + 1 >= n:
                raise TiffError("PackBits run without its byte")
            out += data[i + 1 : i + 2] * (257 - k)
            i += 2
    return bytes(out)


CLEAR, END = 256, 257


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, growing one code early as TIFF does."""
    book = {bytes((i,)): i for i in range(256)}
    size, width, acc, have, out = 258, 9, 0, 0, bytearray()

    def put(code: int) -> None:
        nonlocal acc, have
        acc, have = (acc << width) | code, have + width
        while have >= 8:
            have -= 8
            out.append((acc >> have) & 255)
        acc &= (1 << have) - 1

    put(CLEAR)
    seen = b""
    for i in range(len(data)):
        more = seen + data[i : i + 1]
        if more in book:
            seen = more
            continue
        put(book[seen])
        book[more] = size
        size += 1
        if size == 4094:
            put(CLEAR)
            book = {bytes((i,)): i for i in range(256)}
            size, width = 258, 9
        elif size + 1 > 1 << width:
            width += 1
        seen = data[i : i + 1]
    if seen:
        put(book[seen])
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
    put(END)
    if have:
        out.append((acc << (8 - have)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, need: int | None = None) -> bytes:
    """All of it, or as soon as ``need`` bytes are there."""
    roots = [bytes((i,)) for i in range(256)] + [b"", b""]
    book, width, acc, have, last = roots.copy(), 9, 0, 0, b""
    out, size = [], 0
    for byte in data:
        acc, have = (acc << 8) | byte, have + 8
        if have < width:
            continue
        have -= width
        code = acc >> have
        acc &= (1 << have) - 1
        if code == END:
            break
        if code == CLEAR:
            book, width, last = roots.copy(), 9, b""
            continue
        if not last:
            if code > 255:
                raise TiffError("LZW stream begins with no literal")
            now = book[code]
        elif code < len(book):
            now = book[code]
            book.append(last + now[:1])
        elif code == len(book):
            now = last + last[:1]
            book.append(now)
        else:
            raise TiffError("LZW code out of range")
        out.append(now)
        size += len(now)
        if need is not None and size >= need:
            break
        last = now
        if len(book) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


ENCODE = {STORED: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: packbits_encode}


def _inflate(data: bytes, need: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, need)
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from e


#: Decoders of (data, bytes needed): none makes much more than is needed, whatever the data say.
DECODE = {STORED: lambda data, need: data[:need], LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: packbits_decode}


# -- encoder -------------------------------------------------------------------


def encode(payload: bytes, compression: int = DEFLATE, predictor: int = 2, page_rows: int = 128, strip_rows: int = 32, tile: int = 0, order: str = "<") -> bytes:
    """A grey 8-bit TIFF of UNIT columns whose pixels, page after page, are the payload.

    Its length must be a positive multiple of UNIT.  ``tile`` (a multiple of 16) cuts
    pages into square tiles in place of strips.
    """
    if not payload or len(payload) % UNIT:
        raise ValueError(f"payload must be a positive multiple of {UNIT} bytes")
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for top in range(0, len(pixels), page_rows):
        page = pixels[top : top + page_rows]
        blocks = []
        if tile:
            for y in range(0, len(page), tile):
                for x in range(0, UNIT, tile):
                    part = page[y : y + tile, x : x + tile]
                    blocks.append(np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1])), mode="edge"))
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, len(page), strip_rows)]
        at, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate((block[:, :1], block[:, 1:] - block[:, :-1]), axis=1)
            coded = ENCODE[compression](block.tobytes())
            at.append(len(out))
            sizes.append(len(coded))
            out += coded + b"\0" * (len(coded) & 1)
        tags = {TAG_WIDTH: [UNIT], TAG_HEIGHT: [len(page)], TAG_BITS: [8], TAG_COMPRESSION: [compression], TAG_PHOTOMETRIC: [1], TAG_SAMPLES: [1], TAG_PLANAR: [1], TAG_PREDICTOR: [predictor]}
        tags |= {TAG_TILE_WIDTH: [tile], TAG_TILE_HEIGHT: [tile], TAG_TILES: at, TAG_TILE_SIZES: sizes} if tile else {TAG_STRIPS: at, TAG_STRIP_ROWS: [strip_rows], TAG_STRIP_SIZES: sizes}
        entries = b""
        for tag, values in sorted(tags.items()):
            data = struct.pack(f"{order}{len(values)}I", *values)
            if len(data) > 4:
                place = struct.pack(order + "I", len(out))
                out += data
            else:
                place = data
            entries += struct.pack(order + "HHI", tag, 4, len(values)) + place
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# -- decoder -------------------------------------------------------------------


@dataclass
class Page:
    """One decoded page: pixels as (height, width, samples)."""

    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    pixels: np.ndarray


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list], int]:
    if at + 2 > len(data):
        raise TiffError("directory outside the file")
    (n,) = struct.unpack_from(order + "H", data, at)
    if at + 6 + 12 * n > len(data):
        raise TiffError("directory outside the file")
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in KINDS:
            continue
        form, size = KINDS[kind]
        place = at + 10 + 12 * i
        if size * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if place + size * count > len(data):
            raise TiffError(f"tag {tag} points outside the file")
        tags[tag] = [data[place : place + count]] if form == "s" else list(struct.unpack_from(order + form * count if len(form) > 1 else f"{order}{count}{form}", data, place))
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _undo(block: np.ndarray, predictor: int) -> np.ndarray:
    """block: (rows, columns, samples), differences along the columns."""
    if predictor == 1:
        return block
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    raise TiffError(f"predictor {predictor}")


def _undo_float(raw: np.ndarray, rows: int, cols: int, samples: int, kind: np.dtype, order: str) -> np.ndarray:
    """Predictor 3: byte differences of the rows' byte planes, highest byte first."""
    size = kind.itemsize
    planes = raw.reshape(rows, cols * size, samples)
    summed = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, size, cols * samples)
    return np.ascontiguousarray(summed.transpose(0, 2, 1)).reshape(rows, -1).view(kind.newbyteorder(">")).reshape(rows, cols, samples).astype(kind)


def _unpacked(raw: np.ndarray, rows: int, cols: int, deep: int, bits: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, high bits first; every row begins with a byte."""
    each = np.unpackbits(raw.reshape(rows, -1), axis=1)[:, : cols * deep * bits].reshape(rows, cols, deep, bits)
    return (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)


def directories(data: bytes) -> Iterator[tuple[dict[int, list], str]]:
    """(tags, byte order) of each page, in the order of the directories."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic != 42:
        raise TiffError("no classic TIFF")
    seen = set()
    while at:
        if at in seen:
            raise TiffError("directories form a loop")
        seen.add(at)
        tags, at = _directory(data, at, order)
        yield tags, order


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF in the order of its directories."""
    for number, (tags, order) in enumerate(directories(data)):
        yield _page(data, tags, order, number)


def _page(data: bytes, tags: dict[int, list], order: str, number: int) -> Page:
    def one(tag: int, default: int | None = None) -> int | None:
        value = (tags.get(tag) or [default])[0]
        if value is not None and not isinstance(value, int):
            raise TiffError(f"tag {tag} is no whole number")
        return value

    width, height, samples = one(TAG_WIDTH), one(TAG_HEIGHT), one(TAG_SAMPLES, 1)
    bits, coded, predictor, planar = one(TAG_BITS, 1), one(TAG_COMPRESSION, 1), one(TAG_PREDICTOR, 1), one(TAG_PLANAR, 1)
    if not width or not height or width < 0 or height < 0:
        raise TiffError("a page without width or height")
    if samples < 1 or planar not in (1, 2):
        raise TiffError("a page without samples")
    if coded not in DECODE:
        raise TiffError(f"compression {coded}")
    if any(b != bits for b in tags.get(TAG_BITS, [bits])) or bits not in (1, 2, 4, 8, 16, 32, 64):
        raise TiffError(f"{bits} bits a sample")
    if predictor not in (1, 2, 3) or predictor > 1 and bits < 8:
        raise TiffError(f"predictor {predictor} of {bits} bits")
    name = {1: "u", 2: "i", 3: "f"}.get(one(TAG_FORMAT, 1), "u") + str(max(bits, 8) // 8)
    if name in ("f1",) or predictor == 3 and name[0] != "f":
        raise TiffError(f"format {name} with predictor {predictor}")
    kind = np.dtype(name)
    if width * height * samples * kind.itemsize > LARGEST:
        raise TiffError(f"more than {LARGEST} bytes of pixels")
    tiled = TAG_TILES in tags
    bw, bh = (one(TAG_TILE_WIDTH), one(TAG_TILE_HEIGHT)) if tiled else (width, min(one(TAG_STRIP_ROWS, height), height))
    if not bw or not bh or bw < 0 or bh < 0:
        raise TiffError("strips or tiles without rows or columns")
    where, sizes = tags.get(TAG_TILES if tiled else TAG_STRIPS, []), tags.get(TAG_TILE_SIZES if tiled else TAG_STRIP_SIZES, [])
    across, down = math.ceil(width / bw), math.ceil(height / bh)
    planes = samples if planar == 2 else 1
    if len(where) < across * down * planes or len(sizes) < len(where):
        raise TiffError("too few strips or tiles")
    if not all(isinstance(x, int) and x >= 0 for x in (*where, *sizes)):
        raise TiffError("strips or tiles at no whole number")
    deep = 1 if planar == 2 else samples
    if bw * bh * deep * kind.itemsize > LARGEST:
        raise TiffError(f"a tile of more than {LARGEST} bytes")
    out = None
    for k in range(across * down * planes):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * bh, cell % across * bw
        rows = bh if tiled else min(bh, height - y)
        if where[k] + sizes[k] > len(data):
            raise TiffError("strip outside the file")
        need = rows * (bw * deep * bits + 7 >> 3)
        raw = np.frombuffer(DECODE[coded](data[where[k] : where[k] + sizes[k]], need), np.uint8)
        if len(raw) < need:
            raise TiffError("strip too short")
        if out is None:  # not before a strip is there
            out = np.empty((height, width, samples), kind)
        if predictor == 3:
            block = _undo_float(raw[:need], rows, bw, deep, kind, order)
        elif bits < 8:
            block = _unpacked(raw[:need], rows, bw, deep, bits)
        else:
            block = _undo(raw[:need].view(kind.newbyteorder(order)).astype(kind, copy=False).reshape(rows, bw, deep), predictor)
        h, w = min(rows, height - y), min(bw, width - x)
        out[y : y + h, x : x + w, plane if planar == 2 else slice(None)] = block[:h, :w, 0] if planar == 2 else block[:h, :w]
    return Page(number, width, height, samples, bits, coded, out)


# -- DataFrame operators ----------------------------------------------------------


def payload_of(text: bytes) -> bytes:
    return text + bytes((FILL,)) * (UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """(id, n_bytes, media): every text (null: empty) as a lossless TIFF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [b"" if t is None else t.tobytes() for t in raw_texts(column(part, "text"))]
                media = [encode(payload_of(t), **options) for t in texts]
                yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


PAGE_COLUMNS = "page int, width int, height int, samples int, bits int, compression int, pixels binary, error string"


def read_pages(media: DataFrame, media_col: str = "media") -> DataFrame:
    """(own, page, width, height, samples, bits, compression, pixels, error): a row per page, in order.

    ``own`` holds the row's other columns, of any name.  Samples of less than 8 bits come as bytes.  A page that
    can't be decoded gives a row with its number, null pixels and the reason in ``error``, and the next directory is
    tried; a null medium, and directories that can't be followed further, give one without a number.
    """
    keep = [f for f in media.schema if f.name != media_col]
    own_kind = StructType(keep or [StructField("none", BooleanType())])
    names = ["own", *(x.split()[0] for x in PAGE_COLUMNS.split(", "))]

    def walk(m: pa.Scalar) -> Iterator[tuple]:
        try:
            if not m.is_valid:
                raise TiffError("null")
            data = m.as_py()
            for number, (tags, order) in enumerate(directories(data)):
                try:
                    p = _page(data, tags, order, number)
                except TiffError as e:
                    yield (number, *(None,) * 6, str(e))
                    continue
                yield p.number, p.width, p.height, p.samples, p.bits, p.compression, p.pixels.tobytes(), None
        except TiffError as e:
            yield (None,) * 7 + (str(e),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * 6 + [pa.binary(), pa.string()]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, rows, own = b.slice(at, 256), [], []
                for i, m in enumerate(column(part, "media")):
                    for row in walk(m):
                        rows.append(row)
                        own.append(i)
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([column(part, "own").take(pa.array(own, pa.int64())), *cols], names)

    schema = StructType([StructField("own", own_kind), *StructType.fromDDL(PAGE_COLUMNS).fields])
    own = F.struct(*[F.col(f"`{f.name}`") for f in keep]) if keep else F.struct(F.lit(None).cast("boolean").alias("none"))
    return media.select(own.alias("own"), F.col(media_col).alias("media")).mapInArrow(run, schema)


def digest(page_rows: DataFrame) -> DataFrame:
    """Per document, from its consecutive page rows: sizes, digests and a feature string.

    ``page_rows`` has (id, n_bytes, media_bytes, media_sha256) and the page
    columns.  A document's pages follow one another within a partition, as
    :func:`read_pages` leaves them, so nothing is shuffled; a page numbered 0
    begins the next document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def close() -> None:
            if now:
                head, sha, n, tail, counts, number, shape = now
                p = counts / max(n, 1)
                value = np.arange(256)
                mean = float(p @ value)
                spread = math.sqrt(max(float(p @ (value - mean) ** 2), 0.0))
                some = p[p > 0]
                entropy = float(-(some * np.log2(some)).sum()) + 0.0
                out.append((*head[:2], n, sha.hexdigest(), zlib.crc32(tail[-32:]), *head[2:], f"pages={number};shape={shape};mean={mean:.4f};std={spread:.4f};entropy={entropy:.4f}"))

        def flush() -> pa.RecordBatch:
            names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [id_kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return batch

        id_kind = None
        for b in batches:
            id_kind = column(b, "id").type
            for r in zip(*(column(b, c) for c in ("id", "n_bytes", "media_bytes", "media_sha256", "page", "width", "height", "pixels", "error")), strict=True):
                head, (page, width, height, pixels, error) = [x.as_py() for x in r[:4]], [x.as_py() for x in r[4:]]
                if error is not None:
                    raise TiffError(error)
                if page == 0:
                    close()
                    now = [head, hashlib.sha256(), 0, b"", np.zeros(256, np.int64), 0, ""]
                now[1].update(pixels)
                now[2] += len(pixels)
                now[3] = pixels
                now[4] += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
                now[5] += 1
                now[6] = f"{width}x{height}" if page == 0 else now[6]
            if len(out) >= 1024:
                yield flush()
        close()
        if out:
            yield flush()

    kind = page_rows.schema["id"].dataType.simpleString()
    return page_rows.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def payload_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as a TIFF, reads its pages back and digests them.

    Null texts are empty ones; an empty payload is one unit of fill.  A row each,
    repeated ids included.  Other columns of ``docs`` are not read.
    """
    media = store(docs, id_col, text_col)
    sized = media.select("id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    found = read_pages(sized).select("own.*", "page", "width", "height", "pixels", "error")
    return digest(found).withColumnRenamed("id", id_col)
