"""Media columns: TIFF files written, walked and decoded, one row per page."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, documents

# Fixed values of the TIFF format: tags, compressions, predictors, and bytes of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
LZW_CLEAR, LZW_END, LZW_MOST = 256, 257, 4094


def packbits(data: bytes) -> bytes:
    """Runs of three equal bytes or more are repeated, others written out; each row of a strip may be packed for itself."""
    out = bytearray()
    a = np.frombuffer(data, np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]]) if len(a) else np.zeros(1, int)
    long_ = np.flatnonzero(np.diff(edges) >= 3)
    at = 0

    def plain(to):
        nonlocal at
        while at < to:
            n = min(128, to - at)
            out.append(n - 1)
            out.extend(data[at : at + n])
            at += n

    for k in long_.tolist():
        a0, a1 = int(edges[k]), int(edges[k + 1])
        plain(a0)
        while at < a1:
            n = min(128, a1 - at)
            if n == 1:
                plain(a1)
            else:
                out.append(257 - n)
                out.append(data[at])
                at += n
    plain(len(data))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i, end = [], 0, len(data)
    got = 0
    while i < end and got < size:
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + n + 2])
            got += n + 1
            i += n + 2
        elif n > 128:
            out.append(data[i + 1 : i + 2] * (257 - n))
            got += 257 - n
            i += 2
        else:
            i += 1
    return b"".join(out)[:size]


def _codes_to_bytes(codes: list[int], widths: list[int]) -> bytes:
    c, w = np.array(codes, dtype=np.uint32), np.array(widths)
    starts = np.cumsum(w) - w
    bits = np.zeros(int(w.sum()) + 7 & ~7, dtype=np.uint8)
    for k in range(12):  # the k-th bit of each code
        has = w > k
        bits[starts[has] + k] = (c[has] >> (w[has] - 1 - k).astype(np.uint32)) & 1
    return np.packbits(bits).tobytes()


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bit first, widened one code early."""
    fresh = {bytes([i]): i for i in range(256)}
    table, codes, widths = dict(fresh), [LZW_CLEAR], [9]
    word, size, width = b"", 258, 9
    put, put_width = codes.append, widths.append
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        put_width(width)
        table[longer] = size
        size += 1
        if size >= LZW_MOST:
            put(LZW_CLEAR)
            put_width(12)
            table, size, width = dict(fresh), 258, 9
        elif size >= 2048:
            width = 12
        elif size >= 1024:
            width = 11
        elif size >= 512:
            width = 10
        word = data[i : i + 1]
    if word:
        put(table[word])
        put_width(width)
        size += 1
        if size >= LZW_MOST:
            put(LZW_CLEAR)
            put_width(12)
            size = 258
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    put(LZW_END)
    put_width(width)
    return _codes_to_bytes(codes, widths)


_SINGLES = [bytes([i]) for i in range(256)] + [b"", b""]


def unlzw(data: bytes, size: int) -> bytes:
    out, got = [], 0
    table, width, before = list(_SINGLES), 9, b""
    held = bits = 0
    pos, end = 0, len(data)
    put, add = out.append, table.append
    while got < size:
        while bits < width:
            if pos >= end:
                return b"".join(out)[:size]
            held = (held << 24) | int.from_bytes(data[pos : pos + 3].ljust(3, b"\0"), "big")
            pos += 3
            bits += 24
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == LZW_CLEAR:
            table, width, before = list(_SINGLES), 9, b""
            add = table.append
            continue
        if code == LZW_END:
            break
        n = len(table)
        if before:
            if code < n:
                word = table[code]
            elif code == n:
                word = before + before[:1]
            else:
                raise ValueError("LZW code beyond the table")
            add(before + word[:1])
            n += 1
            if n >= 511:
                width = 12 if n >= 2047 else 11 if n >= 1023 else 10
        else:
            if code >= 256:
                raise ValueError("LZW code beyond the table")
            word = table[code]
        put(word)
        got += len(word)
        before = word
    return b"".join(out)[:size]


def _pack(raw: bytes, compression: int) -> bytes:
    if compression == LZW:
        return lzw(raw)
    if compression == PACKBITS:
        return packbits(raw)
    return zlib.compress(raw, 1) if compression in (DEFLATE, OLD_DEFLATE) else raw


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data[:size]
    if compression == LZW:
        return unlzw(data, size)
    if compression == PACKBITS:
        return unpackbits(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size) if size else b""
    raise ValueError(f"compression {compression}")


def write_tiff(payload: bytes, width: int, samples: int, page_rows: int, compression: int, predictor: int = 1, strip_rows: int = 64, tile: int = 0) -> bytes:
    """A little-endian file of 8-bit pages with `page_rows` rows at most; strips, or tiles of `tile` x `tile` pixels."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width, samples)
    parts, at = [struct.pack("<2sHI", b"II", 42, 8)], 8
    starts = range(0, len(image), page_rows)
    for page in starts:
        rows = image[page : page + page_rows]
        if tile:
            h, w = -len(rows) % tile, -width % tile
            padded = np.pad(rows, ((0, h), (0, w), (0, 0)))
            blocks = [padded[y : y + tile, x : x + tile] for y in range(0, len(padded), tile) for x in range(0, width + w, tile)]
        else:
            blocks = [rows[y : y + strip_rows] for y in range(0, len(rows), strip_rows)]
        packed = []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1)
            packed.append(_pack(b.tobytes(), compression))
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [len(rows)]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1])]
        fields += [(SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        names = (TILE_OFFSETS, TILE_COUNTS) if tile else (STRIP_OFFSETS, STRIP_COUNTS)
        fields += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile])] if tile else [(ROWS_PER_STRIP, 4, [strip_rows])]
        head = 2 + 12 * (len(fields) + 2) + 4
        extra_at = at + head
        extra = b""
        sizes = [len(p) for p in packed]
        long_fields = sum(len(v) * FIELD_BYTES[t] for _, t, v in fields if len(v) * FIELD_BYTES[t] > 4) + (8 * len(packed) if len(packed) > 1 else 0)
        long_fields += long_fields & 1
        data_at = extra_at + long_fields
        offsets = [data_at]
        for n in sizes[:-1]:
            offsets.append(offsets[-1] + n)
        fields = sorted([*fields, (names[0], 4, offsets), (names[1], 4, sizes)])
        entries = b""
        for tag, kind, values in fields:
            raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                entries += struct.pack("<HHII", tag, kind, len(values), extra_at + len(extra))
                extra += raw
            else:
                entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        extra = extra.ljust(long_fields, b"\0")
        body = b"".join(packed)
        end = data_at + len(body)
        end += end & 1
        more = end if page + page_rows < len(image) else 0
        parts += [struct.pack("<H", len(fields)), entries, struct.pack("<I", more), extra, body]
        if end > data_at + len(body):
            parts.append(b"\0")
        at = end
    return b"".join(parts)


def read_tiff(data: bytes):
    """(width, height, samples, pixel bytes) of each page: directories in their order, strips or tiles, either byte order.

    Raises ValueError for what isn't such a file, for samples of other than 8 bits and for directories in a circle.
    """
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    e = "<" if data[:1] == b"I" else ">"
    (at,) = struct.unpack_from(e + "I", data, 4)
    seen = set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("a directory out of place")
        seen.add(at)
        (n,) = struct.unpack_from(e + "H", data, at)
        tags: dict[int, list[int]] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * k)
            size = FIELD_BYTES.get(kind, 1) * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(e + "I", data, at + 10 + 12 * k)[0]
            if kind in (1, 3, 4):
                tags[tag] = list(struct.unpack_from(e + str(count) + {1: 'B', 3: 'H', 4: 'I'}[kind], data, place))
        width, height = tags[WIDTH][0], tags[HEIGHT][0]
        samples, compression = tags.get(SAMPLES, [1])[0], tags.get(COMPRESSION, [1])[0]
        if set(tags.get(BITS, [1])) != {8}:
            raise ValueError("only samples of 8 bits")
        planes = samples if tags.get(PLANAR, [1])[0] == 2 else 1
        depth = samples // planes
        image = np.zeros((planes, height, width, depth), np.uint8)
        if TILE_OFFSETS in tags:
            bw, bh, offsets, sizes = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0], tags[TILE_OFFSETS], tags[TILE_COUNTS]
        else:
            bw, bh, offsets, sizes = width, min(tags.get(ROWS_PER_STRIP, [height])[0], height), tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
        across, down = -(-width // bw), -(-height // bh)
        for k, (offset, size) in enumerate(zip(offsets, sizes)):
            plane, rest = divmod(k, across * down)
            y, x = rest // across * bh, rest % across * bw
            rows = bh if TILE_OFFSETS in tags else min(bh, height - y)
            raw = _unpack(data[offset : offset + size], compression, rows * bw * depth)
            block = np.frombuffer(raw.ljust(rows * bw * depth, b"\0"), np.uint8).reshape(rows, bw, depth)
            if tags.get(PREDICTOR, [1])[0] == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            part = image[plane, y : y + rows, x : x + bw]
            part[:] = block[: part.shape[0], : part.shape[1]]
        yield width, height, samples, (image[0] if planes == 1 else np.moveaxis(image[..., 0], 0, -1)).tobytes()
        (at,) = struct.unpack_from(e + "I", data, at + 2 + 12 * n)


def tiff_pages(media: DataFrame, key="doc_id", content="content") -> DataFrame:
    """key, page, width, height, samples, pixels and error: one row per page of every file.

    A null or broken file gives one row with page null and error set, and pages before the break are kept. Repeated
    keys and null keys give their own rows, an empty table none; other columns are not read.
    """
    schema = "key long, page int, width int, height int, samples int, pixels binary, error string"

    def run(batches):
        for batch in batches:
            for k, data in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                try:
                    if data is None:
                        raise ValueError("null")
                    rows.extend((k, i, *page, None) for i, page in enumerate(read_tiff(data)))
                except (ValueError, KeyError, IndexError, struct.error, zlib.error, ZeroDivisionError) as e:
                    rows.append((k, None, None, None, None, None, str(e)))
                types = [pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in schema.split(", ")])

    return media.select(F.col(key).cast("long").alias("key"), F.col(content).alias("content")).mapInArrow(run, schema)


UNIT = 192  # bytes of a pixel row: 64 pixels of 3 samples
PAGE_ROWS = 512
#: Compression, predictor (only with LZW and deflate, as other readers take it), tile size.
FORMS = ((DEFLATE, 2, 0), (PACKBITS, 1, 0), (LZW, 1, 0), (DEFLATE, 2, 16), (DEFLATE, 1, 0), (PACKBITS, 1, 16), (NONE, 1, 0), (DEFLATE, 1, 16))


def pad(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def store(payload: bytes) -> bytes:
    """The file of a payload; its checksum chooses compression, predictor and layout, so all readers are used."""
    compression, predictor, tile = FORMS[zlib.crc32(payload) % len(FORMS)]
    return write_tiff(payload, UNIT // 3, 3, PAGE_ROWS, compression, predictor, tile=tile)


def feature(payload: bytes) -> str:
    """64 bits as hex: whether each of 64 columns of the pixels is brighter on average than their median."""
    sums = np.frombuffer(payload, np.uint8).reshape(-1, UNIT).sum(axis=0, dtype=np.int64).reshape(-1, 3).sum(axis=1)
    return np.packbits(sums > np.median(sums)).tobytes().hex()


def store_texts(docs: DataFrame, doc_id="doc_id", text="text", with_media=False) -> DataFrame:
    """Every whole text as a TIFF file, read back: sizes, digests and a feature of what the pages hold.

    A null text is empty, and an empty one is one row of blanks; texts of any length become pages of up to 512 rows.
    Equal texts have equal values; null doc_ids and repeated rows have their own rows, an empty table none; other
    columns are not read. with_media adds the files.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"
    schema += ", content binary" * with_media
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary()]

    def run(batches):
        for ids, texts in chunks(batches, ["doc_id", "text"]):
            rows = []
            for i, t in zip(ids, texts):
                n, payload = pad(t)
                media = store(payload)
                pages = [p[3] for p in read_tiff(media)]
                back = b"".join(pages)
                rows.append((i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(back), len(pages)) + ((media,) if with_media else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op2_tiff_pages(spark, sf_dir) -> DataFrame:
    return store_texts(documents(spark, sf_dir))
