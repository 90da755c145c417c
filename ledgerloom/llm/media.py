"""Media columns: PNG files in binary columns, and what can be computed from their samples.

The PNG format is read and written here with zlib and numpy: chunks with their checksums, the five
line filters, 8 bits a sample. A feature hash is the sign pattern of the low frequencies of a
cosine transform of the picture, reduced to 32 by 32 grey values.

Defined results: null text is empty; bytes 32 are appended up to a positive multiple of 192, so
empty text is one line of 64 blank pixels; equal texts give equal files and hashes; other columns
stay as they are, and where one has the name of a new column, that gets underscores in front; a
null file has null features; a file that is damaged (signature, checksum, size, filter type) raises
ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import fresh, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
LINE = 192
IDAT_BYTES = 1 << 16
SIDE, LOW = 32, 8
FEATURES = T.StructType([T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("dct_hash", T.BinaryType())])
ARROW_FEATURES = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("dct_hash", pa.binary())])
#: Rows of the cosine transform that are kept.
COSINES = np.cos(np.pi / SIDE * (np.arange(SIDE) + 0.5) * np.arange(LOW)[:, None])


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(samples: np.ndarray, level: int = 3) -> bytes:
    """samples: (height, width, channels), 8 bits each. Of the filters none, sub and up, that with the smallest sum of absolute differences is used."""
    samples = np.asarray(samples, np.uint8)
    height, width, channels = samples.shape
    lines = samples.reshape(height, width * channels)
    sub, up = lines.copy(), lines.copy()
    sub[:, channels:] -= lines[:, :-channels]
    up[1:] -= lines[:-1]
    kind, best = min(enumerate((lines, sub, up)), key=lambda x: int(np.abs(x[1].view(np.int8).astype(np.int16)).sum()))
    data = zlib.compress(np.concatenate([np.full((height, 1), kind, np.uint8), best], axis=1).tobytes(), level)
    head = struct.pack(">IIBBBBB", width, height, 8, {n: c for c, n in CHANNELS.items()}[channels], 0, 0, 0)
    parts = [_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")])


def _unfilter(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """The five line filters undone. Files with one kind of filter, and sub lines, take whole-array steps."""
    height, width = lines.shape
    if (kinds == 0).all():
        return lines
    if (kinds == 2).all():
        return np.add.accumulate(lines, axis=0, dtype=np.uint8)
    out = np.zeros((height + 1, width), np.uint8)
    if (subs := kinds == 1).any():
        out[1:][subs] = np.add.accumulate(lines[subs].reshape(-1, width // step, step), axis=1, dtype=np.uint8).reshape(-1, width)
        if subs.all():
            return out[1:]
    for y in range(height):
        kind, above, here = kinds[y], out[y], out[y + 1]
        if kind == 0:
            here[:] = lines[y]
        elif kind == 2:
            here[:] = lines[y] + above
        elif kind in (3, 4):
            left, corner = np.zeros(step, np.int16), np.zeros(step, np.int16)
            for x in range(0, width, step):
                over = above[x : x + step].astype(np.int16)
                if kind == 3:
                    guess = (left + over) >> 1
                else:
                    p = left + over - corner
                    a, b, c = abs(p - left), abs(p - over), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, over, corner))
                left, corner = (lines[y, x : x + step] + guess) & 255, over
                here[x : x + step] = left
        elif kind != 1:
            raise ValueError(f"PNG: filter type {kind}")
    return out[1:]


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels); every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("PNG: signature")
    at, parts, head, ended = 8, [], None, False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("PNG: cut off")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data) or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"PNG: checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended, at = kind == b"IEND", at + 12 + n
    if head is None or not ended:
        raise ValueError("PNG: no header or end")
    width, height, depth, color, *other = head
    if depth != 8 or color not in CHANNELS or any(other):
        raise ValueError("PNG: only 8-bit samples without interlacing")
    step = CHANNELS[color]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if raw.size != height * (1 + width * step):
        raise ValueError("PNG: size")
    raw = raw.reshape(height, 1 + width * step)
    return _unfilter(raw[:, 0], raw[:, 1:], step).reshape(height, width, step)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 by 8 lowest frequencies lie above their median."""
    grey = samples.sum(axis=2, dtype=np.float64)
    for axis in (0, 1):
        n = grey.shape[axis]
        if n >= SIDE:
            edges = np.arange(SIDE) * n // SIDE
            shape = [-1 if a == axis else 1 for a in (0, 1)]
            grey = np.add.reduceat(grey, edges, axis=axis) / np.diff(np.append(edges, n)).reshape(shape)
        else:
            grey = np.take(grey, np.arange(SIDE) * n // SIDE, axis=axis)
    low = np.round(COSINES @ grey @ COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + b" " * (-len(raw) % LINE if raw else LINE)


def png_of(text: str | None) -> bytes:
    """A text's bytes as the samples of a picture 64 pixels wide, red, green and blue."""
    return encode_png(np.frombuffer(payload_of(text), np.uint8).reshape(-1, LINE // 3, 3))


def features_of(file: bytes) -> dict:
    """What the samples of a stored file hold."""
    samples = decode_png(file)
    payload = samples.tobytes()
    return {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "dct_hash": cosine_hash(samples)}


@F.arrow_udf(T.BinaryType())
def text_to_png(texts: pa.Array) -> pa.Array:
    return pa.array([png_of(t.as_py()) for t in texts], pa.binary())


@F.arrow_udf(FEATURES)
def png_features(files: pa.Array) -> pa.Array:
    return pa.array([features_of(f.as_py()) if f.is_valid else None for f in files], ARROW_FEATURES)


@F.arrow_udf(T.StructType([T.StructField("media", T.BinaryType()), T.StructField("features", FEATURES)]))
def stored_features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The file of each text and what it holds, read back from the file; a slice of a batch at a time."""
    for batch in texts:
        files, found = [], []
        for text in batch:
            files.append(png_of(text.as_py()))
            found.append(features_of(files[-1]))
        yield pa.StructArray.from_arrays([pa.array(files, pa.binary()), pa.array(found, ARROW_FEATURES)], names=["media", "features"])


def with_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with a PNG column made from a text column."""
    (name,) = fresh(df, media)
    return df.withColumn(name, text_to_png(F.col(text)))


def with_features(df: DataFrame, media: str = "media", features: str = "features") -> DataFrame:
    """df with the struct of features of a PNG column."""
    (name,) = fresh(df, features)
    return df.withColumn(name, png_features(F.col(media)))


def with_media_and_features(df: DataFrame, text: str = "text", media: str = "media", features: str = "features") -> DataFrame:
    """df with a PNG column and its features, both from one pass: no file is made twice."""
    both, media, features = fresh(df, "stored", media, features)
    made = df.withColumn(both, stored_features(F.col(text)))
    return made.withColumns({media: F.col(both)["media"], features: F.col(both)["features"]}).drop(both)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    got = with_media_and_features(docs)
    return got.select(
        "doc_id",
        "n_bytes",
        F.col("features.payload_bytes").alias("payload_bytes"),
        F.col("features.payload_sha256").alias("payload_sha256"),
        F.col("features.tail_crc32").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("features.dct_hash")).alias("feature"),
    )
