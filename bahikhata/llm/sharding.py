"""Extendible hashing into shards of a byte limit.

The directory is indexed by the leading bits of a 60-bit hash of the doc_id. A bucket over the limit splits on one more
bit, the others stay, until every shard fits. Sizes are summed by hash prefix, a few bits deeper than even hashing
would need, in one shuffle of pre-aggregated sums; the levels above are sums of sums. Only buckets still too
large there are counted deeper, FINE bits at a time, from their own documents.

Cases: null and empty texts have 0 bytes; null doc_ids hash alike. Rows with one doc_id (repeats, nulls) share all
60 bits, so a second 60 bits follow, of the text and of the row's number among those with its doc_id and text. A single
document over the limit is a shard of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bahikhata.llm.common import fresh, text_of, with_numbers, written

LIMIT = 8 << 20
#: Bits of the first hash; depth to which sizes are summed at first, at least, and bits beyond the expected depth.
BITS, FINE, SPARE = 60, 8, 4


def _prefix(bits: str, depth: int | Column) -> Column:
    return F.substring(F.col(bits), F.lit(1), F.lit(depth) if isinstance(depth, int) else depth)


def _same(docs: DataFrame) -> Column:
    """A number of the row's doc_id and text."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), text_of())


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, same, number (of the row among those with its doc_id and text), bits: the two hashes as a string of 0 and 1, the first of the doc_id."""
    digest = lambda c: F.lpad(F.conv(F.substring(F.md5(c), 1, 15), 16, 2), BITS, "0")
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), _same(docs).alias("same"), F.monotonically_increasing_id().alias("_row"))
    rows = with_numbers(written(rows, "shard-rows", thin=True)[0], ["same"], "number")
    first = digest(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return rows.withColumn("bits", F.concat(first, digest(F.concat_ws(":", "same", "number")))).select("doc_id", "n_bytes", "same", "number", "bits")


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(shard, depth, shard_bytes): the leaves; a shard is a bit prefix, '' the root.

    A bucket splits if it is over the limit and holds more than one document. Sums never grow with depth, so a leaf
    is a bucket that doesn't split under a parent that does: one join of the levels with themselves, no descent.
    """
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    top, deep = 0, max(FINE, (total // limit).bit_length() + SPARE)
    leaves, open_ = None, rows
    while True:
        cells, _ = written(open_.groupBy(_prefix("bits", deep).alias("bits")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")), "shard-sums", thin=True)
        depth = F.explode(F.sequence(F.lit(top), F.lit(deep))).alias("depth")
        levels = cells.select("bits", "b", "n", depth).groupBy("depth", _prefix("bits", F.col("depth")).alias("shard")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("n"))
        levels, _ = written(levels.withColumn("splits", (F.col("shard_bytes") > limit) & (F.col("n") > 1)), "shard-levels", thin=True)
        parents = levels.where("splits").select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("_up"))
        found = levels.join(parents, (levels["depth"] == parents["depth"]) & (F.expr("substring(shard, 1, length(shard) - 1)") == F.col("_up")), "left")
        found = found.where(~F.col("splits") & (F.col("_up").isNotNull() | (levels["depth"] == top))).select("shard", levels["depth"], "shard_bytes")
        leaves = found if leaves is None else leaves.unionByName(found)
        over = levels.where(F.col("splits") & (F.col("depth") == deep)).select(F.col("shard").alias("_over"))
        if over.isEmpty():
            return written(leaves, "shards", thin=True)[0]
        open_ = open_.join(over, _prefix("bits", deep) == F.col("_over"), "left_semi")
        # At depth ``deep`` the over-full buckets are parents, not leaves, so the next levels start one deeper.
        parents_at, deep = deep, deep + FINE
        top = parents_at + 1


def sharded(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes, same, number: one row a document."""
    rows, _ = written(hashed(docs), "shard-hashes", thin=True)
    leaves = directory(rows, limit)
    # At most a depth a bit of the two hashes.
    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().toLocalIterator())
    tries = F.array(*[_prefix("bits", d) for d in depths]) if depths else F.array(F.lit(""))
    # A document's leaf is the one of its prefixes that the directory holds; no leaf is a prefix of another.
    keyed = rows.withColumn("shard", F.explode(F.array_distinct(tries)))
    return keyed.join(leaves, "shard").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "same", "number")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """The documents themselves, a folder a shard; a shard is within ``limit``, so it is one task's work.

    Rows meet their shards by doc_id and text; of the few that agree in both, each takes a number and the shard of that number. A
    column named ``shard`` would clash with the folders and is an error.
    """
    if "shard" in {c.lower() for c in docs.columns}:
        raise ValueError("the documents have a column named shard")
    same, number = fresh(docs, "_same"), fresh(docs, "_number")
    of, _ = written(sharded(docs, limit).select(F.col("same").alias(same), F.col("number").alias(number), F.concat(F.lit("b"), "shard").alias("shard")), "shard-of", thin=True)
    many = of.where(F.col(number) > 0).select(same).distinct()
    rows = docs.withColumn(same, _same(docs))
    once = rows.join(of.join(many, same, "left_anti").drop(number), same)
    alike, _ = written(rows.join(many, same, "left_semi").select(F.struct(*docs.columns).alias("docs"), same, F.monotonically_increasing_id().alias("_row")), "shard-alike")
    alike = with_numbers(alike, [same], number).join(of, [same, number]).select("docs.*", "shard")
    once.select(*docs.columns, "shard").unionByName(alike).repartition("shard").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    return sharded(docs).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes")
