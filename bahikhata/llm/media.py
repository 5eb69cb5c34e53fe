"""PNG in binary columns: a greyscale writer and reader, and low-frequency cosine-transform hashes.

A payload becomes a PNG of 8-bit grey samples, SIDE a row: the image goes through the filter (none, sub or up)
that leaves the least entropy, then one zlib stream, then chunks with CRCs. Reading tests the
signature, every chunk's CRC and the sizes, inflates, and undoes the filters with numpy: cumulative sums for sub
and up over runs of rows, column by column for average and Paeth, which other writers use. The feature is a
perceptual hash: mean brightness on a GRID x GRID raster, its two-dimensional cosine transform, and the signs of
the KEEP x KEEP lowest frequencies against their median, in hex.

Cases: a null or empty text is one row of blanks; a text of any length is one image; equal texts give equal
bytes; a damaged image raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bahikhata.llm.common import small_batches, text_of, written

SIDE = 192
GRID, KEEP = 32, 8
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_COSINES = np.cos(np.pi * (2 * np.arange(GRID)[None, :] + 1) * np.arange(KEEP)[:, None] / (2 * GRID))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(samples: np.ndarray) -> bytes:
    """The PNG of an (h, w) uint8 array."""
    rows, columns = samples.shape
    left, up = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    ways = (samples, left, up)
    shares = [np.bincount(x.ravel(), minlength=256) / x.size for x in ways]
    kind = int(np.argmin([-(p[p > 0] * np.log2(p[p > 0])).sum() for p in shares]))
    lines = np.concatenate([np.full((rows, 1), kind, np.uint8), ways[kind]], axis=1)
    head = struct.pack(">IIBBBBB", columns, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def samples(data: bytes) -> np.ndarray:
    """The (h, w) samples of an 8-bit greyscale PNG, after all its tests."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, head, parts, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        size, kind = struct.unpack(">I4s", data[at:at + 8])
        body = data[at + 8:at + 8 + size]
        if len(body) < size or data[at + 8 + size:at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale image, or cut off")
    columns, rows = head[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if len(raw) != rows * (columns + 1):
        raise ValueError("wrong size")
    return unfiltered(raw.reshape(rows, columns + 1))


def unfiltered(lines: np.ndarray) -> np.ndarray:
    """Samples of filtered rows; one byte a sample. Runs of rows with one filter are undone together."""
    kinds, body = lines[:, 0], lines[:, 1:]
    out = np.zeros(body.shape, np.uint8)
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kinds)]):
        kind = int(kinds[first]) if last > first else 0
        part, above = body[first:last], out[first - 1] if first else np.zeros(body.shape[1], np.uint8)
        if kind == 0:
            out[first:last] = part
        elif kind == 1:
            out[first:last] = np.cumsum(part, axis=1, dtype=np.uint8)
        elif kind == 2:
            out[first:last] = np.cumsum(part, axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for i in range(first, last):
                before = out[i - 1].astype(int).tolist() if i else [0] * body.shape[1]
                a = c = 0
                line = []
                for x, b in zip(body[i].tolist(), before):
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        near = a + b - c
                        guess = min((abs(near - a), 0, a), (abs(near - b), 1, b), (abs(near - c), 2, c))[2]
                    a, c = (x + guess) & 255, b
                    line.append(a)
                out[i] = line
        else:
            raise ValueError(f"filter {kind}")
    return out


def feature(image: np.ndarray) -> str:
    """64 signs of low frequencies, as 16 hex digits."""
    def raster(x: np.ndarray) -> np.ndarray:
        edges = np.arange(GRID + 1) * len(x) / GRID
        sums = np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
        whole = np.minimum(edges.astype(int), len(x) - 1)
        at = sums[whole] + (edges - whole)[:, None] * x[whole]
        return np.diff(at, axis=0) * GRID / len(x)

    rows = image.astype(np.float64)
    small = raster(raster(rows).T).T
    low = (_COSINES @ small @ _COSINES.T).ravel()
    return np.packbits(low > np.median(low)).tobytes().hex()


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + b" " * (-len(raw) % SIDE or (0 if raw else SIDE))


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary): a written table of PNGs."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            data = [payload_of(t) for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "n_bytes": [len(t.encode()) for t in rows["text"]], "media": [png(np.frombuffer(x, np.uint8).reshape(-1, SIDE)) for x in data]})
    small_batches(docs.sparkSession)
    return written(docs.select("doc_id", text_of().alias("text")).mapInPandas(run, "doc_id long, n_bytes long, media binary"), "media", "none")[0]


def features(media: DataFrame) -> DataFrame:
    """Reads the images back: doc_id, n_bytes, media, payload (binary), feature."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            images = [samples(x) for x in rows["media"]]
            yield rows.assign(doc_id=rows["doc_id"].astype("Int64"), payload=[x.tobytes() for x in images], feature=[feature(x) for x in images])
    return media.mapInPandas(run, "doc_id long, n_bytes long, media binary, payload binary, feature string")


def digest(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for rows in batches:
            images = [samples(x) for x in rows["media"]]
            data = [x.tobytes() for x in images]
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "n_bytes": rows["n_bytes"], "payload_bytes": [len(x) for x in data], "payload_sha256": [sha(x) for x in data], "tail_crc32": [zlib.crc32(x[-16:]) for x in data],
                                "media_bytes": [len(x) for x in rows["media"]], "media_sha256": [sha(x) for x in rows["media"]], "feature": [feature(x) for x in images]})
    return stored(docs).mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
