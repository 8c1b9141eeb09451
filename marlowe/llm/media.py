"""Media columns: Netpbm and BMP images to numpy arrays, area-resized by integral images, written as NPY tiles with difference hashes.

A tile file holds the tiles of some thousand rows as one NPY array; a row has its file and its place in it. Files get
names of their own and rows name closed files only, so a lost executor or a second attempt leaves a stray file, never
a wrong one.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlowe.llm import common

HEADER = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 for height x width arrays of bytes, P6 for height x width x 3."""
    kind = b"P5" if image.ndim == 2 else b"P6"
    return kind + b"\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def scaled(values: np.ndarray, top: int) -> np.ndarray:
    """Samples from 0 to ``top`` as bytes from 0 to 255, rounded; what is above the top is the top."""
    if top == 255 and values.dtype == np.uint8:
        return values
    if not 0 < top < 1 << 32:
        raise ValueError("a sample's largest value must be positive")
    return ((np.minimum(values.astype(np.int64), top) * 255 + top // 2) // top).astype(np.uint8)


def decode_netpbm(data: bytes) -> np.ndarray:
    """Binary P4, P5 and P6 and plain P1, P2 and P3, with comments; samples of any depth come as bytes, scaled."""
    if not re.match(rb"P[1-6][\s#]", data[:3]):
        raise ValueError("not a Netpbm image")
    kind, at, fields = int(data[1:2]), 2, []
    while len(fields) < (2 if kind in (1, 4) else 3):
        m = HEADER.match(data, at)
        if not m:
            raise ValueError("the Netpbm header is cut short")
        fields.append(int(m[1]))
        at = m.end()
    width, height, top, planes = fields[0], fields[1], (fields + [1])[2], 3 if kind in (3, 6) else 1
    shape = (height, width, 3) if planes == 3 else (height, width)
    if kind <= 3:
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = np.array([c - 48 for c in body if c in b"01"] if kind == 1 else body.split(), np.int64)[: width * height * planes]
        return scaled(1 - values if kind == 1 else values, 1 if kind == 1 else top).reshape(shape)
    body = data[at + 1 :]
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(body, np.uint8, height * ((width + 7) // 8)).reshape(height, -1), axis=1)[:, :width]
        return scaled(1 - bits, 1)
    return scaled(np.frombuffer(body, ">u2" if top > 255 else np.uint8, width * height * planes), top).reshape(shape)


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit BMP of a height x width x 3 array of bytes."""
    height, width = image.shape[:2]
    row = (width * 3 + 3) // 4 * 4
    body = np.zeros((height, row), np.uint8)
    body[:, : width * 3] = image[::-1, :, ::-1].reshape(height, -1)
    return b"BM" + struct.pack("<IHHI IiiHHIIiiII", 54 + body.size, 0, 0, 54, 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8 (with a palette), 16, 24 or 32 bits, bottom-up or top-down, with bit fields or without."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    offset, head, width, height, _, depth, packed = struct.unpack_from("<I I i i H H I", data, 10)
    if head < 40 or packed not in (0, 3) or depth not in (1, 4, 8, 16, 24, 32) or width <= 0:
        raise ValueError("a BMP of this kind is not supported")
    row = (width * depth + 31) // 32 * 4
    body = np.frombuffer(data, np.uint8, row * abs(height), offset).reshape(abs(height), row)
    body = body[::-1] if height > 0 else body
    if depth <= 8:
        colours = np.frombuffer(data, np.uint8, (offset - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
        bits = np.unpackbits(body, axis=1).reshape(abs(height), -1, depth)[:, :width]
        return colours[bits @ (1 << np.arange(depth)[::-1])][:, :, 2::-1]
    if depth == 24:
        return body[:, : width * 3].reshape(abs(height), width, 3)[:, :, ::-1]
    pixels = np.ascontiguousarray(body[:, : width * depth // 8]).view(f"<u{depth // 8}")
    masks = struct.unpack_from("<III", data, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F) if depth == 16 else (0xFF0000, 0xFF00, 0xFF)
    planes = [scaled((pixels & pixels.dtype.type(m)) >> pixels.dtype.type((m & -m).bit_length() - 1), m // (m & -m)) if m else np.zeros(pixels.shape, np.uint8) for m in masks]
    return np.stack(planes, axis=2)


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, from one integral image; a target cell may cut through source pixels. Any size, also upwards.

    Between the corners of pixels the integral image is bilinear, so interpolating it at the cells' edges is exact.
    """
    n, m = image.shape[:2]
    at = np.zeros((n + 1, m + 1, *image.shape[2:]))
    at[1:, 1:] = image.astype(np.float64).cumsum(0).cumsum(1)
    for axis, size, full in ((0, height, n), (1, width, m)):
        edge = np.arange(size + 1) * (full / size)
        low = np.minimum(edge.astype(np.int64), full)
        part = (edge - low).reshape([-1 if a == axis else 1 for a in range(at.ndim)])
        here = at.take(low, axis)
        at = here + part * (at.take(np.minimum(low + 1, full), axis) - here)
    return np.diff(np.diff(at, axis=0), axis=1) * (height * width / (n * m))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, one for each of 8 x 8 neighbours in a 9 x 8 grey tile: 1 if the right one is brighter."""
    grey = image if image.ndim == 2 else image.mean(axis=2)
    tile = area_resize(grey, 8, 9)
    return np.packbits((tile[:, 1:] > tile[:, :-1] + 1e-9).reshape(-1)).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tile_of(data: bytes | None, size: int) -> tuple[np.ndarray, str, int, int] | None:
    """The colour tile of an image, its difference hash, height and width; None for what is no image."""
    try:
        image = decode(data)
        small = area_resize(image, size, size).round().astype(np.uint8)
        return (small if small.ndim == 3 else np.repeat(small[:, :, None], 3, axis=2)), difference_hash(image), *image.shape[:2]
    except (ValueError, TypeError, struct.error, IndexError, ZeroDivisionError, OverflowError):
        return None


NEW = [("dhash", T.StringType()), ("height", T.IntegerType()), ("width", T.IntegerType()), ("tile_file", T.StringType()), ("tile_at", T.IntegerType())]


def write_tiles(images: DataFrame, folder: str, *, media_col: str = "media", size: int = 16, rows: int = 1024) -> DataFrame:
    """Writes size x size colour tiles to NPY files of about ``rows`` tiles in ``folder``; gives each row its own by tile_file and tile_at.

    All columns but the media pass through, with dhash, height and width of the image added. Null, empty, cut or unknown
    images get nulls in all five; grey ones have three equal planes. Rows stand alone, repeated ones have a tile each; an
    empty table writes nothing. Clashing names are a ValueError.
    """
    if clash := [c for c in images.columns if c != media_col and c.lower() in dict(NEW)]:
        raise ValueError(f"the input already has {clash}")
    kept = [f for f in images.schema.fields if f.name != media_col]
    where = images.columns.index(media_col)
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in NEW]])

    def flush(held):
        tiles = [x[0] for _, found in held for x in found if x]
        name, at = f"tiles-{uuid.uuid4().hex}.npy", 0
        if tiles:
            fs, root = pafs.FileSystem.from_uri(folder)
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(npy(np.stack(tiles)))
        for batch, found in held:
            columns = [pa.array([x and x[k] for x in found], kind) for k, kind in ((1, pa.string()), (2, pa.int32()), (3, pa.int32()))]
            files = [name if x else None for x in found]
            places = [at + sum(1 for y in found[:i] if y) if x else None for i, x in enumerate(found)]
            at += sum(1 for x in found if x)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != where), *columns, pa.array(files, pa.string()), pa.array(places, pa.int32())], names=schema.names)

    def run(batches):
        held, n = [], 0
        for batch in common.slices(batches):
            held.append((batch, [tile_of(data, size) for data in batch.column(where).to_pylist()]))
            n += batch.num_rows
            if n >= rows:
                yield from flush(held)
                held, n = [], 0
        yield from flush(held)

    return images.mapInArrow(run, schema)


def read_tiles(rows: DataFrame, folder: str, *, new: str = "tile") -> DataFrame:
    """Appends the tile, as NPY bytes of one array, to rows with tile_file and tile_at as ``write_tiles`` gives them; null for none.

    Rows of a file that follow each other open it once. An input that has ``new`` is a ValueError.
    """
    if any(c.lower() == new.lower() for c in rows.columns):
        raise ValueError(f"the input already has {new}")
    file_at, place_at = rows.columns.index("tile_file"), rows.columns.index("tile_at")
    schema = T.StructType([*rows.schema.fields, T.StructField(new, T.BinaryType())])

    def run(batches):
        name, tiles = None, None
        for batch in common.slices(batches):
            out = []
            for file, at in zip(batch.column(file_at).to_pylist(), batch.column(place_at).to_pylist(), strict=True):
                if file is not None and file != name:
                    fs, root = pafs.FileSystem.from_uri(folder)
                    with fs.open_input_stream(f"{root}/{file}") as stream:
                        name, tiles = file, np.load(io.BytesIO(stream.read()), allow_pickle=False)
                out.append(None if file is None else npy(tiles[at]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def payload_image(payload: bytes, columns: int = 64) -> np.ndarray:
    """A colour image of ``columns`` pixels a row whose samples are the payload, a multiple of three times that."""
    return np.frombuffer(payload, np.uint8).reshape(-1, columns, 3)


def text_media(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Appends n_bytes and media to every row: the text's bytes, padded with blanks, as the samples of an image.

    The image is a BMP where the payload's crc32 is odd and a P6 image elsewhere, so equal texts are equal images. Null
    counts as empty; texts of any length are stored whole. Repeated rows stand alone, an empty table stays empty, and an
    input that has either name already is a ValueError.
    """
    new = [("n_bytes", T.LongType()), ("media", T.BinaryType())]
    if clash := [c for c in docs.columns if c.lower() in dict(new)]:
        raise ValueError(f"the input already has {clash}")

    def rows(texts):
        out = []
        for t in texts:
            raw = (t or "").encode()
            payload = raw + b" " * (max(192, (len(raw) + 191) // 192 * 192) - len(raw))
            out.append((len(raw), (encode_bmp if zlib.crc32(payload) & 1 else encode_netpbm)(payload_image(payload))))
        return [[x[0] for x in out], [x[1] for x in out]]

    return common.per_text(docs, text_col, new, rows)


def media_digest(images: DataFrame, *, media_col: str = "media") -> DataFrame:
    """Appends what the stored bytes give when they are decoded: payload and media sizes and hashes, and tail_crc32.

    Null, empty, cut or unknown images give nulls in what needs their samples, null media in all. Rows stand alone;
    other columns pass through, and clashing names are a ValueError.
    """
    new = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType())]
    if clash := [c for c in images.columns if c.lower() in dict(new)]:
        raise ValueError(f"the input already has {clash}")

    def rows(media):
        out = []
        for data in media:
            stored = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
            try:
                payload = decode(data).tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored))
            except (ValueError, TypeError, struct.error, IndexError, ZeroDivisionError, OverflowError):
                out.append((None, None, None, *stored))
        return [[x[i] for x in out] for i in range(5)]

    return common.per_text(images, media_col, new, rows)
