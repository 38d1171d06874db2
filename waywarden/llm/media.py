"""Media columns: byte payloads as lossless WebP images, and pixel arrays read back from them."""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waywarden.llm import webp, webp_batch
from waywarden.llm.common import documents, written

#: A payload is padded with zeros to a positive multiple of this.
UNIT = 64
#: Pixels in a row of an image that has no more rows than the format allows.
ROW = UNIT // 4
#: Images coded side by side.
PART = 8192

STORED = "doc_id long, n_bytes long, payload_bytes long, media binary"
PIXELS = "doc_id long, n_bytes long, width int, height int, pixels binary, media binary"


def image_of(payload: bytes) -> np.ndarray:
    """The payload's bytes as samples, row by row; rows get wider where there would be too many, the last filled with zeros."""
    rows = -(-len(payload) // UNIT)
    wide = -(-rows // webp.MAX_SIDE)
    width, height = ROW * wide, -(-rows // wide)
    return np.frombuffer(payload.ljust(width * height * 4, b"\0"), np.uint8).reshape(height, width, 4)


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\0")


def _store(batches):
    for b in batches:
        for at in range(0, len(b), PART):
            raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in b.column("text").slice(at, PART).to_pylist()]
            payloads = [padded(r) for r in raw]
            media = webp_batch.encode_all([image_of(p) for p in payloads])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(at, PART), pa.array(map(len, raw), pa.int64()), pa.array(map(len, payloads), pa.int64()), pa.array(media, pa.binary())],
                names=["doc_id", "n_bytes", "payload_bytes", "media"],
            )


def store(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, media) for each row of df's texts; null and empty texts are one row of zeros."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, STORED)


def _read(batches):
    for b in batches:
        for at in range(0, len(b), PART):
            part = b.slice(at, PART)
            images = webp_batch.decode_all(part.column("media").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("n_bytes"),
                    pa.array([i.shape[1] for i in images], pa.int32()),
                    pa.array([i.shape[0] for i in images], pa.int32()),
                    pa.array([i.tobytes() for i in images], pa.binary()),
                    part.column("media"),
                ],
                names=[f.split()[0] for f in PIXELS.split(", ")],
            )


def read(stored: DataFrame) -> DataFrame:
    """Stored images to PIXELS: samples in the order red, green, blue, alpha, row by row. Bytes that are no image raise."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_read, PIXELS)


def features(image: np.ndarray) -> str:
    """Width, height, the mean of each channel and how many samples fall into each eighth of the range."""
    means = image.reshape(-1, 4).mean(axis=0)
    eighths = np.bincount(image.reshape(-1) >> 5, minlength=8)
    return f"{image.shape[1]}x{image.shape[0]};" + ",".join(f"{m:.3f}" for m in means) + ";" + ",".join(map(str, eighths))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches):
    for b in batches:
        for at in range(0, len(b), PART):
            part, rows = b.slice(at, PART), []
            files = part.column("media").to_pylist()
            for n, media, image in zip(part.column("payload_bytes").to_pylist(), files, webp_batch.decode_all(files), strict=True):
                payload = image.tobytes()[:n]
                rows.append((sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), sha256(media).hexdigest(), features(image)))
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), part.column("payload_bytes"), *made], names=[f.split()[0] for f in DIGEST.split(", ")])


def op10(spark, sf_dir):
    return written(store(documents(spark, sf_dir)), "media").mapInArrow(_digest, DIGEST)
