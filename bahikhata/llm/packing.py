"""Packing documents into sequences of at most 1024 tokens by non-negative least squares.

Every document gives its full windows, which are sequences of their own, and a tail of 1 to 1023 tokens. The
histogram of tail lengths (1,023 counts, whatever the corpus) is the right-hand side; the columns are the shallow
combinations that fill a window: two or three tails that add up to 1024, and a lone tail whose length is a power
of two. Non-negative least squares gives the repeat counts, which are rounded down to what the histogram holds.
Tails are then numbered within their length, and the number says which repeat of which combination takes them.
The tails left over by rounding are packed greedily, one after the other, cut at the sequences' ends; the last
sequence is cut into powers of two. So nothing is padded.

Cases: a null or empty text is its end id alone; null and repeated doc_ids are documents of their own; a text of
any length is cut into windows inside its task; an empty table gives no sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bahikhata.llm.common import small_batches, text_of, with_offsets, written
from bahikhata.llm.tokens import crc_of, kept_space

WINDOW, END = 1024, 0
#: Rows that one running sum takes, about.
RANGE_ROWS = 50_000
_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The full windows and the tail of every document, with their ids (little-endian, as wide as the
    vocabulary needs); piece is unique."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_space(vocabulary)
        end = np.array([END], encode.kind)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
        for rows in batches:
            out: list[tuple] = []
            for doc, found in zip(rows.column("doc_id").to_pylist(), encode(rows.column("text"))):
                ids = np.concatenate([found, end])
                for at in range(0, len(ids), WINDOW):
                    part = ids[at:at + WINDOW]
                    out.append((doc, at, len(part), crc_of(part), len(ids), part.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, schema.types)], schema=schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, _PIECES).withColumn("piece", F.monotonically_increasing_id())


def combinations(window: int = WINDOW) -> np.ndarray:
    """(k, 3) lengths, 0 for none: lone powers of two, pairs and triples that add up to ``window``."""
    lone = [(1 << i, 0, 0) for i in range(window.bit_length() - 1)]
    pairs = [(a, window - a, 0) for a in range(1, window // 2 + 1)]
    a, b = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
    c = window - a - b
    fits = (a <= b) & (b <= c)
    return np.concatenate([np.array(lone), np.array(pairs), np.stack([a[fits], b[fits], c[fits]], 1)])


def repeats(histogram: np.ndarray, combos: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Whole repeat counts: least squares with x >= 0 (projected gradient with momentum), rounded to fit."""
    size = len(histogram)
    flat = combos.ravel()
    used = flat > 0
    scale = max(float(histogram.max(initial=0)), 1.0)
    want = histogram / scale
    of = lambda x: np.bincount(flat[used], np.repeat(x, 3)[used], size)
    x = np.zeros(len(combos))
    ahead, t, step = x.copy(), 1.0, 1.0 / (3 * np.bincount(flat[used], minlength=size).max())
    for _ in range(rounds):
        miss = want - of(ahead)
        miss[0] = 0
        new = np.maximum(0, ahead + step * miss[combos].sum(axis=1))
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, x, t = new + (t - 1) / later * (new - x), new, later
    left = histogram.astype(np.int64).copy()
    left[0] = np.iinfo(np.int64).max
    counts = np.zeros(len(combos), np.int64)
    # First the solved counts rounded down, then whatever a combination still finds, the larger shares first.
    for share in (np.floor(x * scale).astype(np.int64), None):
        for j in np.argsort(-x, kind="stable"):
            lengths, times = np.unique(combos[j][combos[j] > 0], return_counts=True)
            most = int((left[lengths] // times).min())
            n = most if share is None else min(most, int(share[j]))
            if n > 0:
                left[lengths] -= n * times
                counts[j] += n
    return counts


def slots(counts: np.ndarray, combos: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each length, by the tails' numbers: the first number, first sequence and offset of every run."""
    first = np.cumsum(counts) - counts
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    for j in np.flatnonzero(counts):
        offset = 0
        for length in combos[j][combos[j] > 0].tolist():
            runs.setdefault(length, []).append((taken.get(length, 0), int(first[j]), offset))
            taken[length] = taken.get(length, 0) + int(counts[j])
            offset += length
    return {k: (*map(np.array, zip(*v)), taken[k]) for k, v in runs.items()}


def placed(parts: DataFrame) -> DataFrame:
    """parts (pieces(), written) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids of cut pieces."""
    thin = parts.select("piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.xxhash64("piece").alias("_order"))
    whole, tails = thin.where(F.col("length") == WINDOW), thin.where(F.col("length") < WINDOW)
    counts = {r["length"]: r["n"] for r in thin.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}
    histogram = np.array([0, *(counts.get(i, 0) for i in range(1, WINDOW))], np.int64)
    combos = combinations()
    times = repeats(histogram, combos)
    plan, n_whole, n_plan = slots(times, combos), counts.get(WINDOW, 0), int(times.sum())
    left_tokens = int((histogram * np.arange(WINDOW)).sum() - (times[:, None] * combos).sum())
    ranges = lambda n: max(8, -(-n // RANGE_ROWS))

    one = F.lit(1).cast("long")
    whole = with_offsets(whole.withColumn("_one", one), [], "_order", "_one", "sequence_id", ranges(n_whole))
    whole = whole.select("piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))

    @F.pandas_udf(T.StructType([T.StructField("sequence", T.LongType()), T.StructField("offset", T.LongType())]))
    def slot(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = np.full(len(length), -1, np.int64), np.zeros(len(length), np.int64)
        lengths, numbers = length.to_numpy(), number.to_numpy()
        for k in np.unique(lengths):
            if k in plan:
                at, first, off, total = plan[k]
                rows = np.flatnonzero((lengths == k) & (numbers < total))
                run = np.searchsorted(at, numbers[rows], "right") - 1
                sequence[rows], offset[rows] = first[run] + numbers[rows] - at[run], off[run]
        return pd.DataFrame({"sequence": sequence, "offset": offset})

    tails = with_offsets(tails.withColumn("_one", one), ["length"], "_order", "_one", "number", ranges(int(histogram.sum())))
    tails, _ = written(tails.withColumn("at", slot("length", "number")), "packing-tails", thin=True)
    fitted = tails.where("at.sequence >= 0").select("piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("at.sequence") + n_whole).alias("sequence_id"), F.col("at.offset").alias("offset"))

    rest = with_offsets(tails.where("at.sequence < 0").withColumn("_length", F.col("length").cast("long")), [], "_order", "_length", "at_token", ranges(int(histogram.sum())))
    full = left_tokens // WINDOW * WINDOW
    ends, at = [], full
    for bit in reversed(range(WINDOW.bit_length() - 1)):
        if left_tokens - full >> bit & 1:
            at += 1 << bit
            ends.append(at)
    rest = rest.select("piece", "doc_id", "start", "doc_tokens", "length", "at_token").join(parts.where(F.col("length") < WINDOW).select("piece", "ids"), "piece")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                at, end = r.at_token, r.at_token + r.length
                while at < end:
                    k = int(np.searchsorted(ends, at, "right"))
                    sequence, first, last = (at // WINDOW, at // WINDOW * WINDOW, (at // WINDOW + 1) * WINDOW) if at < full else (full // WINDOW + k, ends[k - 1] if k else full, ends[k])
                    stop = min(end, last)
                    part = np.frombuffer(r.ids, f"<u{len(r.ids) // r.length}")[at - r.at_token:stop - r.at_token]
                    out.append((r.piece, r.doc_id, r.start + at - r.at_token, stop - at, crc_of(part), r.doc_tokens, n_whole + n_plan + sequence, at - first))
                    at = stop
            table = pd.DataFrame(out, columns=["piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            yield table.astype({"doc_id": "Int64"})
    greedy = rest.mapInPandas(cut, "piece long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return whole.unionByName(fitted).unionByName(greedy)


def sequences(parts: DataFrame, places: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, pieces in the order of their offsets."""
    at = places.select("piece", "start", "length", "sequence_id", "offset").join(parts.select("piece", F.col("start").alias("_s"), (F.octet_length("ids") / F.col("length")).cast("int").alias("_w"), "ids"), "piece")
    bytes_ = F.substring("ids", ((F.col("start") - F.col("_s")) * F.col("_w") + 1).cast("int"), (F.col("length") * F.col("_w")).cast("int"))
    rows = at.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", bytes_.alias("ids")))).alias("p"))
    return rows.select("sequence_id", F.concat_ws("", F.transform("p", lambda x: F.hex(x["ids"]))).alias("hex")).select("sequence_id", F.unhex("hex").alias("ids"))


def packed(docs: DataFrame, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    """(pieces with their ids, placements)."""
    small_batches(docs.sparkSession, 500)
    parts, _ = written(pieces(docs, vocabulary), "pieces")
    return parts, placed(parts)


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    return packed(docs, vocabulary)[1].select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
