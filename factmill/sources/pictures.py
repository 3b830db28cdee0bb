"""PNG pictures: their size, and a hash of their pixels that doesn't depend on how they were written."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructType

#: Channels by colour type: grey, RGB, palette, grey with alpha, RGBA.  Fixed values.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def chunks(content: bytes) -> Iterator[tuple[bytes, memoryview]]:
    """Kinds and bodies of the chunks behind the signature."""
    at, view = 8, memoryview(content)
    while at + 12 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        if at + 12 + size > len(content):
            raise ValueError("cut off")
        yield kind, view[at + 8 : at + 8 + size]
        at += 12 + size


def lines(bodies: list[memoryview], size: int) -> Iterator[bytes]:
    """Inflated lines of ``size`` bytes, a few at a time."""
    stream, held = zlib.decompressobj(), bytearray()
    for body in bodies:
        while len(body):
            held += stream.decompress(body, 1 << 20)
            body = stream.unconsumed_tail
            whole = len(held) // size * size
            for at in range(0, whole, size):
                yield bytes(held[at : at + size])
            del held[:whole]


def restored(line: np.ndarray, above: np.ndarray, how: int, step: int) -> np.ndarray:
    """A line without its filter: each byte was stored less a guess from its left, upper and upper left neighbours."""
    if how == 0:
        return line
    if how == 2:
        return line + above
    if how == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if how not in (3, 4):
        raise ValueError("unknown filter")
    out, up = [0] * step + line.tolist(), [0] * step + above.tolist()
    for i in range(step, len(out)):
        left, top, corner = out[i - step], up[i], up[i - step]
        if how == 3:
            guess = (left + top) // 2
        else:
            # the neighbour nearest to left + top - corner; of equal distances the left one counts first, then the upper one
            guess = min((abs(top - corner), 0, left), (abs(left - corner), 1, top), (abs(left + top - 2 * corner), 2, corner))[2]
        out[i] = (out[i] + guess) & 255
    return np.array(out[step:], np.uint8)


def as_png(pixels: np.ndarray, colour: int, how: int = 0, palette: bytes = b"") -> bytes:
    """A small picture as PNG: lines of bytes of a colour type, all with one filter."""
    step, raw, above = CHANNELS[colour], b"", np.zeros(pixels.shape[1], np.int64)
    for line in pixels.astype(np.int64):
        left, corner = (np.concatenate((np.zeros(step, np.int64), x[:-step])) for x in (line, above))
        near = [np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)]
        guess = (0, left, above, (left + above) // 2, np.choose(np.argmin(near, axis=0), (left, above, corner)))[how]
        raw += bytes([how]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    body = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", pixels.shape[1] // step, len(pixels), 8, colour, 0, 0, 0)
    return SIGNATURE + body(b"IHDR", header) + (body(b"PLTE", palette) if palette else b"") + body(b"IDAT", zlib.compress(raw)) + body(b"IEND", b"")


def pixel_hash(content: bytes | None) -> tuple[str | None, int | None, int | None, str | None]:
    """Hash, width, height and error of one picture; line by line, so that memory doesn't grow with it."""
    if not content or content[:8] != SIGNATURE:
        return None, None, None, "not a PNG picture"
    try:
        parts = list(chunks(content))
        header = next((body for kind, body in parts if kind == b"IHDR"), b"")
        if len(header) != 13:
            return None, None, None, "no header"
        width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", header)
        if not width or not height or depth != 8 or colour not in CHANNELS or interlaced:
            return None, width, height, "only eight bits a channel without interlacing are read"
        palette = np.zeros((256, 3), np.uint8)
        for kind, body in parts:
            if kind == b"PLTE":
                given = np.frombuffer(body, np.uint8).reshape(-1, 3)
                palette[: len(given)] = given
        step = CHANNELS[colour]
        found, n = hashlib.sha256(f"{width}x{height}:".encode()), 0
        above = np.zeros(width * step, np.uint8)
        for line in lines([body for kind, body in parts if kind == b"IDAT"], width * step + 1):
            if n == height:
                break
            above = restored(np.frombuffer(line, np.uint8, offset=1), above, line[0], step)
            pixels = above.reshape(-1, step)
            found.update((palette[above] if colour == 3 else pixels[:, :3] if step >= 3 else np.repeat(pixels[:, :1], 3, axis=1)).tobytes())
            n += 1
        return (found.hexdigest(), width, height, None) if n == height else (None, width, height, "cut off")
    except (ValueError, zlib.error) as e:
        return None, None, None, str(e)


def with_pixel_hash(pictures: DataFrame, content: str = "content") -> DataFrame:
    """The rows with ``image_sha256, image_width, image_height, image_error`` in place of their bytes.

    The hash is SHA-256 over size and RGB pixels, whatever compression,
    filters, palette or alpha a PNG has.  What can't be read (null, empty,
    cut off, other formats, 16 bits, interlaced) has a null hash and an error.
    """
    kept = [c for c in pictures.columns if c != content]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # pictures are large: one at a time leaves Arrow
            found = [pixel_hash(x.as_py()) for x in batch.column(len(kept))]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, "image_sha256", "image_width", "image_height", "image_error"])

    schema = StructType([pictures.schema[c] for c in kept])
    for name, kind in (("image_sha256", StringType()), ("image_width", IntegerType()), ("image_height", IntegerType()), ("image_error", StringType())):
        schema = schema.add(name, kind)
    return pictures.select(*kept, content).mapInArrow(hashed, schema)
