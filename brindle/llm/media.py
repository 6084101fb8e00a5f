"""Media columns: texts kept as lossless WebP images, and features of the pixels read back.

A text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576,
are the RGBA samples of images 144 pixels wide. A long text takes several
images of at most `TILE_ROWS` rows, so that no image outgrows a worker's memory.
An image of few colours has a palette. The transforms and codings of the
others follow from the checksum of their pixels and not from size, as none of
them makes text smaller, so that the column holds every one; their parameters
are fitted to the pixels of each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import webp
from brindle.llm.common import crc32

ROW_BYTES, FILL = 576, b"\xff"
WIDTH, TILE_ROWS = ROW_BYTES // 4, 1024


#: Images of 16 that each way of coding gets; the rest have literals and runs of one colour.
SHARES = {"green": 2, "cache": 2, "cross": 1, "references": 1, "predictor": 1, "all": 1}
WAYS = [way for way, n in SHARES.items() for _ in range(n)]
BLOCK, CACHE_BITS, COLOURS = 6, 6, 256
#: Bytes of images that are read side by side.
ABREAST_BYTES = 2_000_000


def copies(argb: np.ndarray) -> list[tuple[int, int, int]]:
    """Back-references (start, length, distance) to the last place of the same pixels, from the left."""
    values, places, found, at = argb.tolist(), {}, [], 0
    while at + webp.LEAST_RUN <= len(values):
        key, n = tuple(values[at : at + webp.LEAST_RUN]), 0
        before = places.get(key)
        if before is not None:
            while at + n < len(values) and n < webp.MOST_RUN and values[before + n] == values[at + n]:
                n += 1
            found.append((at, n, at - before))
        for k in range(at, at + max(n, 1)):
            places[tuple(values[k : k + webp.LEAST_RUN])] = k
        at += max(n, 1)
    return found


def factors(argb: np.ndarray, block: int) -> np.ndarray:
    """The cross-colour factors of each block, by least squares: (A, red to blue, green to blue, green to red)."""
    height, width, _ = argb.shape
    rows, columns = (height - 1 >> block) + 1, (width - 1 >> block) + 1
    place = ((np.arange(height) >> block)[:, None] * columns + (np.arange(width) >> block)).ravel()
    red, green, blue = (((argb[..., k].ravel() & 0xFF) ^ 0x80) - 0x80 for k in (1, 2, 3))

    def slope(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        own = np.bincount(place, x * y, rows * columns) / np.maximum(np.bincount(place, x * x, rows * columns), 1)
        return np.clip(np.rint(32 * own), -128, 127).astype(np.int64)

    to_blue = slope(green, blue)
    red_to_blue = slope(red, blue - (to_blue[place] * green >> 5))
    return np.stack([np.full(rows * columns, 255), red_to_blue, to_blue, slope(green, red)], 1).reshape(rows, columns, 4) & 0xFF


def encode(pixels: np.ndarray) -> bytes:
    """The image with a palette, or in the way that its checksum chooses."""
    argb = np.ascontiguousarray(pixels).view(np.uint32).ravel()
    ordered = np.sort(argb)
    if 1 + np.count_nonzero(ordered[1:] != ordered[:-1]) <= min(COLOURS, len(argb) // 2):  # with more, the palette takes more room than it saves
        return webp.encode(pixels, ((webp.PALETTE,),))
    seed = crc32(pixels.tobytes()) % 16
    way = WAYS[seed] if seed < len(WAYS) else ""
    green = (webp.SUBTRACT_GREEN,)
    if way == "references":
        return webp.encode(pixels, (green,), references=copies(argb))
    transforms: tuple = (green,) if way == "green" else ()
    own = pixels[..., [3, 0, 1, 2]].astype(np.int64) if way in ("predictor", "cross", "all") else None
    if way in ("predictor", "all"):
        modes = webp.best_modes(own, BLOCK)
        transforms = ((webp.PREDICTOR, BLOCK, modes),)
        own = webp.differences(own, modes, BLOCK) if way == "all" else own
    if way in ("cross", "all"):
        transforms += ((webp.CROSS_COLOUR, BLOCK, factors(own, BLOCK)),)
    if way == "all":
        transforms += (green,)
    return webp.encode(pixels, transforms, cache_bits=CACHE_BITS if way in ("cache", "all") else 0)


def to_media(data: bytes) -> list[bytes]:
    """The images of a payload, which is `data` filled up to whole rows."""
    payload = data + FILL * (-len(data) % ROW_BYTES if data else ROW_BYTES)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 4)
    return [encode(rows[at : at + TILE_ROWS]) for at in range(0, len(rows), TILE_ROWS)]


def from_media(images: list[bytes]) -> np.ndarray:
    """The pixels of a media value, its images one below the other."""
    return np.concatenate([webp.decode(image) for image in images])


def many_from_media(rows: list[list[bytes]]) -> Iterator[np.ndarray]:
    """The pixels of each of many media values, whose images are read side by side."""
    for part in _parts(rows):
        pixels = iter(webp.decode_many([image for media in part for image in media]))
        yield from (np.concatenate([next(pixels) for _ in media]) for media in part)


def _parts(rows: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    """Media values in lists of about `ABREAST_BYTES`."""
    part, size = [], 0
    for media in rows:
        part.append(media)
        size += sum(map(len, media))
        if size >= ABREAST_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def feature(pixels: np.ndarray) -> str:
    """Size, mean and deviation of the samples, and the 64-bit average hash of an 8 x 8 thumbnail."""
    flat = pixels.reshape(-1).astype(np.float64)
    grey = flat.reshape(pixels.shape[0], WIDTH * 4)
    lines = np.array([b.mean(0) for b in np.array_split(grey, 8)]) if len(grey) >= 8 else np.repeat(grey, -(-8 // len(grey)), 0)[:8]
    small = lines.reshape(8, 8, -1).mean(2)
    bits = "".join("1" if v else "0" for v in (small > small.mean()).ravel())
    return f"{pixels.shape[1]}x{pixels.shape[0]} mean={flat.mean():.3f} std={flat.std():.3f} ahash={int(bits, 2):016x}"


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media of every row; null texts are empty, equal texts have equal media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                data = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array([to_media(d) for d in data], pa.list_(pa.large_binary()))], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media array<binary>")


def read_features(stored: DataFrame) -> DataFrame:
    """What the stored images say: payload and media sizes and digests, and the feature of each row.

    Repeated rows are read each; a null doc_id stays null; an empty table gives
    no rows.
    """
    schema = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            stored = batch.column(2).to_pylist()
            for media, pixels in zip(stored, many_from_media(stored), strict=True):
                payload, whole = pixels.tobytes(), b"".join(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-32:]), len(whole), hashlib.sha256(whole).hexdigest(), feature(pixels)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True))], ["doc_id", "n_bytes", *(n for n, _ in schema)])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
