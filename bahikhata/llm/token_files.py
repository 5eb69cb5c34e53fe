"""Token ids as frequency-ranked, byte-aligned variable-length integers with separate control bytes.

An id is stored as its rank among all ids of the corpus by falling count (ties: smaller id first), so the
commonest 256 take one byte and the next 65,280 two. Two bits of a control byte give the length of a value, four
values a control byte; control and data bytes stand apart, and decoding is a lookup of the control byte in a
256-row table of lengths and one cumulative sum.

The format is a folder. ``blocks`` holds Parquet files of blocks (shard, block, doc_ids, lengths, control, data): shards are
ranges of doc_id, numbered in order, blocks are numbered inside a shard, rows stand in that order in a file and files
follow each other by name, so reading them by name gives documents in ascending doc_id order. ``ranks`` holds a row
for each id: its rank. A folder can be read without anything else (``read_files``).

Cases: null and empty texts hold the end id only; null doc_ids come first; rows that repeat a doc_id stay
together, ordered by a hash of their texts, and may span shards; a text of any length is one document and its block may
exceed BLOCK.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bahikhata.llm.common import compact, removed, shared_dir, small_batches, text_of, written
from bahikhata.llm.tokens import dropped_space

END = 2
#: Ids in a block, bytes of text in a shard, and shards at most: their bounds go to every task (a few MB), and shards grow beyond.
BLOCK, SHARD_BYTES, SHARDS = 1 << 16, 32 << 20, 100_000
_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.int64)


def coded(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    values = ranks.astype("<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[:len(values)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.tobytes(), data.tobytes()


def decoded(control: bytes, data: bytes, count: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    at = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    values = raw[at].astype(np.uint32)
    for i in (1, 2, 3):
        longer = np.flatnonzero(lengths > i)
        if not len(longer):
            break
        values[longer] |= raw[at[longer] + i].astype(np.uint32) << np.uint32(8 * i)
    return values


def bounds(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(doc_ids, times, nulls): where shards begin. A doc_id that fills several shards stands for as many, and so do null ids."""
    span = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*"), F.count("doc_id")).first()
    n = int(max(2, min(SHARDS, span[0] // SHARD_BYTES + 1, span[1] + 1)))
    nulls = int(n * (span[1] - span[2]) / max(1, span[1]))
    at = docs.select("doc_id").where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)
    ids, times = np.unique(np.array(at, np.int64), return_counts=True)
    return ids, times, nulls


def shards(ids: np.ndarray, null: np.ndarray, share: np.ndarray, cuts: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The shard of each doc_id; ``share`` (0 to 1, by the text) decides between the shards of one doc_id."""
    at, times, nulls = cuts
    before = np.concatenate([[0], np.cumsum(times)])
    place = np.searchsorted(at, ids, "left")
    here = np.append(at, 0)[place] == ids
    here[place == len(at)] = False
    inside = np.where(here, 1 + np.floor(share * np.append(times, 0)[place]), 0).astype(np.int64)
    return np.where(null, np.floor(share * (nulls + 1)).astype(np.int64), nulls + before[place] + inside)


def encoded(docs: DataFrame, vocabulary: str, cuts: tuple[np.ndarray, np.ndarray, int]) -> DataFrame:
    """(shard, doc_id, hash, ids), the end id included, in ids of the vocabulary's width."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = dropped_space(vocabulary)
        end = np.array([END], encode.kind).tobytes()
        for rows in batches:
            ids, hashes = rows.column("doc_id"), rows.column("hash")
            share = (hashes.to_numpy() / 2.0 ** 64 + 0.5).clip(0, 1 - 2 ** -50)
            shard = shards(pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), share, cuts)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), ids, hashes, pa.array([x.tobytes() + end for x in encode(rows.column("text"))], pa.binary())], ["shard", "doc_id", "hash", "ids"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("hash")).mapInArrow(run, "shard int, doc_id long, hash long, ids binary")


def frequencies(tokens: DataFrame, size: int, kind: str) -> np.ndarray:
    """Count of every id; each task sends one row an id at most, and the driver gets ``size`` rows at most."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(size, np.int64)
        for rows in batches:
            if len(rows):
                counts += np.bincount(np.frombuffer(b"".join(rows["ids"]), kind), minlength=size)
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"id": seen.astype("int32"), "n": counts[seen]})
    out = np.zeros(size, np.int64)
    for id_, n in tokens.select("ids").mapInPandas(run, "id int, n long").groupBy("id").agg(F.sum("n")).toLocalIterator():
        out[id_] = n
    return out


def blocks(tokens: DataFrame, rank: np.ndarray, kind: str) -> DataFrame:
    """Consecutive documents of a shard, coded together until they pass BLOCK ids; a shard's rows must stand together."""
    width = np.dtype(kind).itemsize

    def one(shard: int, block: int, doc_ids: list, ids: list[bytes]) -> dict:
        lengths = [len(x) // width for x in ids]
        control, data = coded(rank[np.frombuffer(b"".join(ids), kind)])
        return {"shard": shard, "block": block, "doc_ids": doc_ids, "lengths": lengths, "control": control, "data": data}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["shard", "block", "doc_ids", "lengths", "control", "data"]
        shard, block, doc_ids, ids, held = None, 0, [], [], 0
        for rows in batches:
            out = []
            for s, d, x in zip(rows["shard"], rows["doc_id"].astype(object), rows["ids"]):
                if ids and (s != shard or held >= BLOCK):
                    out.append(one(shard, block, doc_ids, ids))
                    block = block + 1 if s == shard else 0
                    doc_ids, ids, held = [], [], 0
                shard, held = s, held + len(x) // width
                doc_ids.append(None if pd.isna(d) else int(d))
                ids.append(x)
            yield pd.DataFrame(out, columns=names)
        if ids:
            yield pd.DataFrame([one(shard, block, doc_ids, ids)], columns=names)
    return tokens.mapInPandas(run, "shard int, block int, doc_ids array<long>, lengths array<long>, control binary, data binary")


def write_files(docs: DataFrame, vocabulary: str, folder: str | None = None) -> str:
    """Writes the blocks and the ranks; gives the folder (one of its own in the shared folder if none is named)."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    small_batches(spark)
    size = Tokenizer.from_file(vocabulary).get_vocab_size()
    kind = "<u2" if size <= 1 << 16 else "<u4"
    cuts = bounds(docs)
    n = int(cuts[1].sum()) + cuts[2] + 1
    tokens, plain = written(encoded(docs, vocabulary, cuts).repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "doc_id", "hash", "ids"), "ids")
    counts = frequencies(tokens, size, kind)
    by_rank = np.lexsort((np.arange(size), -counts)).astype(np.uint32)
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)
    folder = folder or f"{shared_dir(spark)}/tables/id-files-{uuid.uuid4().hex}"
    # Spark packs the parts of a table by size; the coded blocks, a fifth of the text, are dealt once more so that files follow in order.
    files = blocks(tokens, rank, kind).repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "block")
    compact(files, thin=True).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(size, dtype="int64"), "id": by_rank.astype("int64")})).coalesce(1).write.parquet(f"{folder}/ranks")
    removed(spark, plain)
    return folder


def opened(spark: SparkSession, folder: str) -> tuple[DataFrame, np.ndarray]:
    """The blocks of a folder and the id of each rank (a row an id of the vocabulary)."""
    ranks = spark.read.parquet(f"{folder}/ranks").toPandas().sort_values("rank")
    return spark.read.parquet(f"{folder}/blocks"), ranks["id"].to_numpy(np.uint32)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, block, doc_id, ids): one row a document, ids as decoded little-endian uint32."""
    files, by_rank = opened(spark, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for b in rows.itertuples():
                ends = np.cumsum(b.lengths)
                ids = by_rank[decoded(b.control, b.data, int(ends[-1]))]
                each = np.split(ids, ends[:-1])
                yield pd.DataFrame({"shard": b.shard, "block": b.block, "doc_id": pd.array([None if pd.isna(d) else int(d) for d in b.doc_ids], "Int64"), "ids": [x.astype("<u4").tobytes() for x in each]})
    return files.mapInPandas(run, "shard int, block int, doc_id long, ids binary")


def summaries(files: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """(shard, block, at, doc_id, n_tokens, inside, ids_crc32) of the documents as read back: place and ids before it in its block; the ids stay in the task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for b in rows.itertuples():
                ends = np.cumsum(b.lengths)
                data = memoryview(by_rank[decoded(b.control, b.data, int(ends[-1]))].astype("<u4").tobytes())
                cuts = [0, *(4 * ends).tolist()]
                yield pd.DataFrame({"shard": b.shard, "block": b.block, "doc_id": pd.array([None if pd.isna(d) else int(d) for d in b.doc_ids], "Int64"), "n_tokens": np.asarray(b.lengths, np.int64),
                                    "inside": ends - np.asarray(b.lengths, np.int64), "ids_crc32": [zlib.crc32(data[x:y]) for x, y in zip(cuts, cuts[1:])]})
    return files.mapInPandas(run, "shard int, block int, doc_id long, n_tokens long, inside long, ids_crc32 long")


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    files, by_rank = opened(docs.sparkSession, write_files(docs, vocabulary))
    # A row a block, then a row a shard: the first window sees one shard, the second the shards.
    totals = files.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy().orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shard = totals.groupBy("shard").agg(F.sum("total").alias("total")).select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    starts = totals.withColumn("base_in", F.coalesce(F.sum("total").over(earlier), F.lit(0))).drop("total").join(F.broadcast(shard), "shard")
    return (summaries(files, by_rank).join(starts, ["shard", "block"])
            .select("doc_id", (F.col("base") + F.col("base_in") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))
