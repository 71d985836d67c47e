"""Media columns: Netpbm and BMP images as numpy arrays, area-resized tiles and difference hashes.

Images are decoded to arrays (rows, columns, channels), resized by areas read off integral images (linear
interpolation of the integral at fractional corners is exact for box filters), and kept as NPY tiles with
a 64-bit difference hash. ``bytes_to_image`` stores any bytes without loss as an RGB image 64 pixels wide. ``stored`` makes a column of
image files; ``described`` reads such a column; ``round_trip`` writes the first as a table to the shared folder and gives the second from there.

Defined results: a null text is empty; a text is padded with spaces to a positive multiple of 192 bytes; equal
texts give equal values; rows that repeat give equal rows; an empty table gives an empty table; other columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.bytetext import string_buffers
from sigspark.llm.lineage import Tables

WIDTH = 64
ROW_BYTES = WIDTH * 3
#: Rows of an image whose integral is held at once.
STRIP = 4096


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 for one channel, P6 for three; 8 bits a sample."""
    rows, columns, channels = image.shape
    return b"P%d\n%d %d\n255\n" % ({1: 5, 3: 6}[channels], columns, rows) + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit rows from the bottom up, blue first, padded to four bytes."""
    rows, columns, _ = image.shape
    line = -(-columns * 3 // 4) * 4
    body = np.zeros((rows, line), np.uint8)
    body[:, : columns * 3] = image[::-1, :, ::-1].reshape(rows, -1)
    return struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, columns, rows, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


_NETPBM = re.compile(rb"P([2356])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", re.S)


def decode(data: bytes) -> np.ndarray:
    """The samples of a P2, P3, P5, P6 or uncompressed 8- or 24-bit BMP image; ValueError for anything else."""
    if found := _NETPBM.match(data):
        kind, columns, rows, most = map(int, found.groups())
        channels = 3 if kind in (3, 6) else 1
        size = rows * columns * channels
        if not 0 < most < 256:
            raise ValueError("only 8-bit Netpbm samples")
        flat = np.frombuffer(data, np.uint8, offset=found.end()) if kind > 3 else np.array(data[found.end() :].split()[:size], np.uint8)
        if len(flat) < size:
            raise ValueError("the image is cut off")
        flat = flat[:size] if most == 255 else np.rint(flat[:size] * (255 / most)).clip(0, 255).astype(np.uint8)
        return flat.reshape(rows, columns, channels)
    if data[:2] == b"BM" and len(data) >= 54:
        at, (columns, rows, _, bits, packed) = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<iiHHI", data, 18)
        if bits not in (8, 24) or packed:
            raise ValueError("only uncompressed 8- or 24-bit BMP")
        line, up = -(-columns * bits // 32) * 4, rows > 0
        body = np.frombuffer(data, np.uint8, abs(rows) * line, at).reshape(abs(rows), line)[:, : columns * bits // 8]
        image = body.reshape(abs(rows), columns, bits // 8)
        image = image[::-1] if up else image
        if bits == 24:
            return image[:, :, ::-1]
        colours = (at - 14 - struct.unpack_from("<I", data, 14)[0]) // 4
        table = np.frombuffer(data, np.uint8, colours * 4, at - colours * 4).reshape(-1, 4)[:, 2::-1]
        return table[image[:, :, 0]]
    raise ValueError("not a Netpbm or BMP image")


def _integral_rows(image: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The integral along the rows at the fractional heights ``at``, from strips of bounded size."""
    out = np.empty((len(at), *image.shape[1:]))
    total = np.zeros(image.shape[1:], np.int64)
    for first in range(0, len(image), STRIP):
        strip = image[first : first + STRIP]
        sums = np.concatenate([total[None], total + np.cumsum(strip, axis=0, dtype=np.int64)])
        inside = np.flatnonzero((at >= first) & ((at < first + len(strip)) | (first + len(strip) == len(image))))
        low = np.minimum(at[inside].astype(np.int64) - first, len(strip) - 1)
        part = (at[inside] - first - low)[:, None, None]
        out[inside] = sums[low] * (1 - part) + sums[low + 1] * part
        total = sums[-1]
    return out


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean samples (float) of each cell of a rows x columns grid over the image."""
    down = _integral_rows(image, np.linspace(0, image.shape[0], rows + 1))
    both = np.concatenate([np.zeros((rows + 1, 1, image.shape[2])), np.cumsum(down, axis=1)], axis=1)
    at = np.linspace(0, image.shape[1], columns + 1)
    low = np.minimum(at.astype(np.int64), image.shape[1] - 1)
    part = (at - low)[None, :, None]
    corner = both[:, low] * (1 - part) + both[:, low + 1] * part
    cell = np.diff(np.diff(corner, axis=0), axis=1)
    return cell * (rows * columns / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether grey falls from each cell of an 8 x 9 grid to the next one."""
    grey = np.round(area_resize(image, 8, 9).mean(axis=2), 6)
    return np.packbits(grey[:, :-1] > grey[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 8) -> bytes:
    """The image resized to side x side, as NPY bytes."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(image, side, side)).clip(0, 255).astype(np.uint8))
    return out.getvalue()


def bytes_to_image(data: bytes) -> np.ndarray:
    """The bytes, padded with spaces to a positive multiple of 192, as rows of 64 RGB pixels."""
    padded = data + b" " * (-len(data) % ROW_BYTES if data else ROW_BYTES)
    return np.frombuffer(padded, np.uint8).reshape(-1, WIDTH, 3)


STORED = "doc_id {id}, n_bytes long, media_type string, media binary"
DESCRIBED = "doc_id {id}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, tile binary"
#: Images that a task holds at once.
SLICE = 256


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text as an image file: with an even number of rows a BMP, else Netpbm."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                data, at = string_buffers(part.column(1))
                images = [bytes_to_image(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                bmp = [image.shape[0] % 2 == 0 for image in images]
                files = [encode_bmp(image) if even else encode_netpbm(image) for image, even in zip(images, bmp, strict=True)]
                kinds = ["image/bmp" if even else "image/x-portable-pixmap" for even in bmp]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(kinds, pa.string()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media_type", "media"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(work, STORED.format(id=_kind(narrow)))


def described(media: DataFrame) -> DataFrame:
    """Sizes, digests, difference hash and tile of each image file that ``stored`` made; its samples are read from the file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.column(3):
                data = file.as_py()
                image = decode(data)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(image), npy_tile(image)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) if rows else [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns[:6], batch.column(2), columns[6]], names=[x.split()[0] for x in DESCRIBED.split(", ")])

    return media.select("doc_id", "n_bytes", "media_type", "media").mapInArrow(work, DESCRIBED.format(id=_kind(media)))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an image file in a table in the shared folder, read the files back and describe them."""
    return described(Tables(docs.sparkSession).cut(stored(docs, id_col, text_col)))
