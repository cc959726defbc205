"""TIFF media columns: files made from bytes, and one row per page read back from them.

The reader walks the chain of image directories of a file of either byte order, decodes the strips or
tiles of each page (stored plain, PackBits, LZW or deflate), undoes the horizontal predictor, and
crops tiles to the page. Pages are 8-bit, with one or more samples per pixel side by side.

Edge cases of `tiff_pages`: a null or empty file, or one that is no whole TIFF, gives one row with
page -1 and the reason in `error`; null ids and repeated rows are read like any other; an empty table
gives no rows; other columns are ignored. `tiff_stored` takes null for the empty text, which is one
line of padding.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import column, documents, mapped, small_batches, utf8

LINE = 576  # bytes of a line; payloads are padded to whole lines
PAGE_LINES = 64
STRIP_LINES = 16
TILE = 64

# Fixed values of the format: tag numbers, field types and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
FIELD = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, STOP = 256, 257
# Bytes that one byte of each compression stands for at most: an LZW code of 9 to 12 bits stands for
# less than 4096 bytes, a deflated match of 258 bytes takes two bits.
MOST_FOLD = {PLAIN: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040}


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 2:
            out += bytes([257 - (j - i), data[i]])
            i = j
            continue
        j = i
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, that widen one code early."""
    out, acc, bits, width = bytearray(), 0, 0, 9
    table, last = {}, b""

    def put(code):
        nonlocal acc, bits
        acc = (acc << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append((acc >> bits) & 255)
        acc &= (1 << bits) - 1

    put(CLEAR)
    table = {bytes([i]): i for i in range(256)}
    following = 258
    for b in data:
        longer = last + bytes([b])
        if longer in table:
            last = longer
            continue
        put(table[last])
        table[longer] = following
        following += 1
        if following == 4095:
            put(CLEAR)
            table = {bytes([i]): i for i in range(256)}
            following, width = 258, 9
        elif following == 1 << width:
            width += 1
        last = bytes([b])
    if last:
        put(table[last])
        following += 1
        if following == 1 << width and width < 12:
            width += 1
    put(STOP)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    out, acc, bits, width, at = bytearray(), 0, 0, 9, 0
    table: list[bytes] = []
    last = b""
    while len(out) < size:
        while bits < width:
            if at >= len(data):
                raise ValueError("the LZW codes end early")
            acc = ((acc << 8) | data[at]) & 0xFFFFFF
            at += 1
            bits += 8
        bits -= width
        code = (acc >> bits) & ((1 << width) - 1)
        if code == STOP:
            break
        if code == CLEAR:
            table = [bytes([i]) for i in range(256)] + [b"", b""]
            width, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("an LZW code has no entry")
        out += entry
        if last:
            table.append(last + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        last = entry
    return bytes(out)


def compressed(data: bytes, kind: int) -> bytes:
    if kind == PACKBITS:
        return pack_bits(data)
    if kind == LZW:
        return lzw(data)
    return zlib.compress(data, 1) if kind in (DEFLATE, OLD_DEFLATE) else data


def expanded(data: bytes, kind: int, size: int) -> bytes:
    if kind == PACKBITS:
        out = unpack_bits(data, size)
    elif kind == LZW:
        out = unlzw(data, size)
    elif kind in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif kind == PLAIN:
        out = data
    else:
        raise ValueError(f"compression {kind} is not known")
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out[:size]


def write_tiff(pages: list[np.ndarray], kind: int, predictor: int = 1, tiled: bool = False, order: str = "<") -> bytes:
    """A file of 8-bit grey pages (2-d arrays of uint8)."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for page in pages:
        height, width = page.shape
        if tiled:
            down, across = -(-height // TILE), -(-width // TILE)
            padded = np.zeros((down * TILE, across * TILE), np.uint8)
            padded[:height, :width] = page
            cells = [padded[y * TILE : (y + 1) * TILE, x * TILE : (x + 1) * TILE] for y in range(down) for x in range(across)]
        else:
            cells = [page[y : y + STRIP_LINES] for y in range(0, height, STRIP_LINES)]
        places, sizes = [], []
        for cell in cells:
            if predictor == 2:
                cell = np.concatenate([cell[:, :1], cell[:, 1:] - cell[:, :-1]], axis=1)
            data = compressed(cell.tobytes(), kind)
            places.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [kind]), (PHOTOMETRIC, 3, [1])]
        if tiled:
            fields += [(SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor]), (TILE_WIDTH, 3, [TILE]), (TILE_HEIGHT, 3, [TILE]), (TILE_OFFSETS, 4, places), (TILE_BYTES, 4, sizes)]
        else:
            fields += [(STRIP_OFFSETS, 4, places), (SAMPLES, 3, [1]), (ROWS_PER_STRIP, 4, [STRIP_LINES]), (STRIP_BYTES, 4, sizes), (PREDICTOR, 3, [predictor])]
        entries = b""
        for tag, field, values in fields:
            code, width_of = FIELD[field]
            raw = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(raw) > 4:
                spot = struct.pack(order + "I", len(out))
                out += raw
            else:
                spot = raw.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, field, len(values)) + spot
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_pages(raw: bytes):
    """Yields (page, width, height, samples, compression, predictor, pixels) of a file."""
    if len(raw) < 8 or raw[:2] not in (b"II", b"MM"):
        raise ValueError("no TIFF header")
    order = "<" if raw[:2] == b"II" else ">"
    magic, at = struct.unpack_from(order + "HI", raw, 2)
    if magic != 42 or at == 0:
        raise ValueError("no TIFF header or no page")
    seen, page = set(), 0
    while at:
        if at in seen:
            raise ValueError("the image directories form a circle")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", raw, at)
        tags: dict[int, tuple] = {}
        for i in range(n):
            tag, field, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
            if field not in FIELD:
                continue
            code, size = FIELD[field]
            spot = at + 10 + 12 * i
            if count * size > 4:
                (spot,) = struct.unpack_from(order + "I", raw, spot)
            if count * size > len(raw):
                raise ValueError("a field is longer than the file")
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", raw, spot)
        one = lambda tag, other: tags[tag][0] if tags.get(tag) else other
        width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        kind, predictor = one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
        if not width or not height or any(b != 8 for b in tags.get(BITS, (1,))):
            raise ValueError("a page is not of 8-bit samples")
        if not samples or kind not in MOST_FOLD:
            raise ValueError("samples or compression are not known")
        tiled = TILE_OFFSETS in tags
        wide = one(TILE_WIDTH, 0) if tiled else width
        tall = one(TILE_HEIGHT, 0) if tiled else min(height, one(ROWS_PER_STRIP, height))
        places, sizes = (tags.get(t, ()) for t in ((TILE_OFFSETS, TILE_BYTES) if tiled else (STRIP_OFFSETS, STRIP_BYTES)))
        across = -(-width // wide) if wide else 0
        if not across or not tall or len(places) < across * -(-height // tall) or len(sizes) < len(places):
            raise ValueError("strips or tiles are missing")
        # Before anything of that size is made.
        if max(height * width, wide * tall) * samples > MOST_FOLD[kind] * len(raw):
            raise ValueError("the page is larger than its file can hold")
        pixels = np.empty((height, width * samples), np.uint8)
        for k in range(across * -(-height // tall)):
            y, x = k // across * tall, k % across * wide
            rows = tall if tiled else min(tall, height - y)
            data = expanded(raw[places[k] : places[k] + sizes[k]], kind, rows * wide * samples)
            cell = np.frombuffer(data, np.uint8).reshape(rows, wide, samples)
            if predictor == 2:
                cell = np.cumsum(cell, axis=1, dtype=np.uint8)
            elif predictor != 1:
                raise ValueError(f"predictor {predictor} is not known")
            cell = cell[: height - y, : width - x].reshape(min(rows, height - y), -1)
            pixels[y : y + len(cell), x * samples : x * samples + cell.shape[1]] = cell
        yield page, width, height, samples, kind, predictor, pixels
        page += 1
        (at,) = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)


def _store(batches):
    import pyarrow as pa

    for batch in small_batches(batches, "text"):
        sizes, files = [], []
        for raw in utf8(batch, "text"):
            lines = max(1, -(-len(raw) // LINE))
            grid = np.full(lines * LINE, 255, np.uint8)
            grid[: len(raw)] = np.frombuffer(raw, np.uint8)
            grid = grid.reshape(lines, LINE)
            pages = [grid[i : i + PAGE_LINES] for i in range(0, lines, PAGE_LINES)]
            # The check sum of the text picks the form, so equal texts have equal files and each codec
            # and predictor meets short and long texts, one page and several. Tiles are for texts that
            # fill one: padding would be most of a shorter text's file.
            form = zlib.crc32(raw)
            kind, predictor = (PACKBITS, LZW, DEFLATE)[form % 3], 1 + form // 3 % 2
            files.append(write_tiff(pages, kind, predictor, tiled=lines >= TILE and form // 6 % 2 == 1))
            sizes.append(len(raw))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])


def tiff_stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with 255 to whole lines, as a file."""
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    return mapped(rows, _store, "doc_id long, n_bytes long, media binary")


def _read(pixels_too: bool):
    def run(batches):
        import pyarrow as pa

        names = ["page", "width", "height", "samples", "compression", "predictor", "last", "so_far_bytes", "so_far_sha256", "tail_crc32", "media_sha256", "feature", "error"]
        kinds = [pa.int64()] * 6 + [pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        if pixels_too:
            names, kinds = [*names, "pixels"], [*kinds, pa.binary()]
        for batch in small_batches(batches, "media"):
            where, rows = [], []
            for i, raw in enumerate(utf8(batch, "media")):
                first = len(rows)
                try:
                    sha, size, tail = hashlib.sha256(), 0, b""
                    histogram, steps = np.zeros(256, np.int64), 0
                    for page, width, height, samples, kind, predictor, pixels in read_pages(raw):
                        data = pixels.tobytes()
                        sha.update(data)
                        size += len(data)
                        tail = (tail + data)[-32:]
                        histogram += np.bincount(pixels.ravel(), minlength=256)
                        steps += int((pixels[:, 1:] != pixels[:, :-1]).sum())
                        mean = float(histogram @ np.arange(256)) / size
                        feature = f"pages={page + 1};width={width};mean={mean:.4f};values={int((histogram > 0).sum())};steps={steps}"
                        rows.append([page, width, height, samples, kind, predictor, False, size, sha.hexdigest(), zlib.crc32(tail), None, feature, None, *([data] if pixels_too else [])])
                        where.append(i)
                    rows[-1][6], rows[-1][10] = True, hashlib.sha256(raw).hexdigest()
                except (ValueError, struct.error, zlib.error, OverflowError, MemoryError) as error:
                    del rows[first:], where[first:]
                    rows.append([-1, *[None] * 5, True, *[None] * 5, str(error), *([None] if pixels_too else [])])
                    where.append(i)
            columns = list(zip(*rows))
            keep = batch.drop_columns(["media"]).take(pa.array(where))
            yield pa.RecordBatch.from_arrays([*keep.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], [*keep.schema.names, *names])

    return run


def tiff_pages(files: DataFrame, id_col: str = "doc_id", media_col: str = "media", pixels: bool = True) -> DataFrame:
    """One row for each page of each file: its place, form and samples, and of all samples up to this
    page their number, digest, the check sum of the last 32, and features; `last` marks the last page."""
    rows = files.select(
        column(files, id_col).alias("doc_id"), F.octet_length(column(files, media_col)).cast("long").alias("media_bytes"),
        column(files, media_col).alias("media"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    ddl = (
        f"doc_id {kind}, media_bytes long, page long, width long, height long, samples long, compression long, predictor long, "
        "last boolean, so_far_bytes long, so_far_sha256 string, tail_crc32 long, media_sha256 string, feature string, error string"
    )
    return mapped(rows, _read(pixels), ddl + (", pixels binary" if pixels else ""))


def op8_tiff(spark, sf_dir):
    stored = tiff_stored(documents(spark, sf_dir))
    keyed = stored.withColumn("id", F.struct("doc_id", "n_bytes"))
    return (
        tiff_pages(keyed, id_col="id", pixels=False).where(F.col("last"))
        .select(
            "doc_id.doc_id", "doc_id.n_bytes", F.col("so_far_bytes").alias("payload_bytes"),
            F.col("so_far_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature",
        )
    )


ORACLE: dict[str, str] = {}
