"""SimHash near-duplicates by pigeonring filtering.

Two fingerprints that differ in at most ``LIMIT`` of 64 bits are linked. Cut into five consecutive segments
on a ring, the budget is LIMIT / 5 of a difference a segment; then some segment starts a chain whose first l
segments differ in at most l * LIMIT / 5 bits together, for every l: 0, 1, 2 and 3 bits for one to four
segments. The first two steps make the join key (segment k equal, segment k + 1 within one bit), so a
candidate already agrees in 25 bits or more; the chains of three and four segments prune the rest before the
full Hamming test. The filter is exact: no link is lost.

Components need fewer links than there are. First each fingerprint is held against the least one under each key that it looks at, which makes a
star of a group of near copies; then only fingerprints of different components are held against each other, under keys of several.

Cases: a null or empty text, or one without a word, has fingerprint 0 and is linked like any other. Equal
fingerprints form one class and are joined once, so copies are never expanded into pairs. Null and repeated
doc_ids are kept as rows; component_id ignores nulls. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bahikhata.llm.common import LOWER, UPPER, shared_dir, text_of, written

LIMIT = 4
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans(UPPER, LOWER)
_PIECE = 1 << 15


def fingerprint(text: str) -> int:
    """Signed 64-bit majority of the shingles' XXH64, four words a shingle, repeats counted."""
    words = _WORDS.findall(text.translate(_LOWER))
    if not words:
        return 0
    n = max(1, len(words) - 3)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        end = min(n, at + _PIECE)
        part = words[at:end + 3]
        shingles = map(" ".join, zip(part, part[1:], part[2:], part[3:])) if len(words) > 3 else [" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), ">u8", end - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), _fingerprints(text_of(text_col)).alias("fp"))


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, STARTS[k]).bitwiseAND(F.lit((1 << WIDTHS[k]) - 1))


def _ring_key(k: int, first: Column, second: Column) -> Column:
    return F.lit(k << 26) + F.shiftleft(first, 13) + second


def _keys(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, a): the ring keys under which a fingerprint stands, and (key, b): those under which it must look, one differing bit allowed in the second segment."""
    fp = F.col("fp")
    stored, asked = [], []
    for k in range(5):
        n = (k + 1) % 5
        first, second = _segment(fp, k), _segment(fp, n)
        stored.append(_ring_key(k, first, second))
        asked += [_ring_key(k, first, second.bitwiseXOR(F.lit(flip))) for flip in (0, *(1 << i for i in range(WIDTHS[n])))]
    return classes.select(F.explode(F.array(*stored)).alias("key"), fp.alias("a")), classes.select(F.explode(F.array(*asked)).alias("key"), fp.alias("b"))


def _linked(pairs: DataFrame) -> DataFrame:
    """Pairs (key, a, b) whose chain of segments stays within the budgets, and which then differ in 1 to LIMIT bits."""
    differ = F.col("a").bitwiseXOR(F.col("b"))
    masks = [sum(((1 << WIDTHS[j % 5]) - 1) << STARTS[j % 5] for j in (k, k + 1, k + 2)) for k in range(5)]
    longer = [m | ((1 << WIDTHS[(k + 3) % 5]) - 1) << STARTS[(k + 3) % 5] for k, m in enumerate(masks)]
    signed = [[x - (1 << 64) if x >> 63 else x for x in xs] for xs in (masks, longer)]
    start = F.shiftright(F.col("key"), 26).cast("int") + 1
    chains = [F.bit_count(differ.bitwiseAND(F.element_at(F.array(*[F.lit(x).cast("bigint") for x in xs]), start))) <= most
              for xs, most in zip(signed, (2, 3))]
    return pairs.where(F.col("a") != F.col("b")).where(chains[0]).where(chains[1]).where(F.bit_count(differ) <= LIMIT).select("a", "b").distinct()


def matched(classes: DataFrame) -> DataFrame:
    """(key, b, a, n): each fingerprint with each key that it looks at and that others stand under, the least of these, and how many stand there. Written."""
    index, probe = _keys(classes)
    # Spark's estimates don't see the exploded keys: unhinted, it would broadcast the keys of a table that is small itself, through the driver.
    met = probe.join(index.groupBy("key").agg(F.min("a").alias("a"), F.count("*").alias("n")).hint("merge"), "key")
    return written(met.where("n > 1 or a <> b").select("key", "b", "a", "n"), "simhash-matched", thin=True)[0]


def to_least(met: DataFrame) -> DataFrame:
    """(a, b): links from each fingerprint to the least one under each of its keys; a fingerprint gives a bounded number of candidates.

    A group of near copies, in which all are within reach of the least, comes out as a star and not as all its pairs.
    """
    return _linked(met)


def between(classes: DataFrame, met: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): the links between different components of ``roots`` (node, root) that ``to_least`` didn't show.

    Only keys of several fingerprints are left. Under each of them those of the component that has most don't look at each other; all others
    are held against all, from both sides.
    """
    crowded = met.where("n > 1")
    named = roots.select(F.col("node").alias("_fp"), F.col("root").alias("_root"))
    stored = _keys(classes)[0].join(crowded.select("key").distinct(), "key", "left_semi").join(named, F.col("a") == F.col("_fp"), "left")
    stored, _ = written(stored.select("key", "a", F.coalesce("_root", "a").alias("root_a")), "simhash-crowded", thin=True)
    sizes = stored.groupBy("key", "root_a").agg(F.count("*").alias("n"))
    most = sizes.groupBy("key").agg(F.max(F.struct("n", "root_a"))["root_a"].alias("most"), F.count("*").alias("roots"))
    asked = crowded.select("key", "b").join(most, "key").join(named, F.col("b") == F.col("_fp"), "left").withColumn("root_b", F.coalesce("_root", "b"))
    inside = F.col("root_b") == F.col("most")
    sides = F.when(inside, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    asked = asked.where(~inside | (F.col("roots") > 1)).select("key", "b", "root_b", F.explode(sides).alias("side"))
    held = stored.join(most.select("key", "most"), "key").select("key", "a", "root_a", (F.col("root_a") != F.col("most")).cast("int").alias("side"))
    return _linked(asked.join(held, ["key", "side"]).where("root_a <> root_b").select("key", "a", "b"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node that can be reached, by alternating large-star and small-star steps.

    Each step is two shuffles at most on the remaining links and ends in a checkpoint, so a lost executor costs one
    step, and no plan holds a step twice: the driver's threads and plans grow with the exchanges planned. Rounds grow with
    the logarithm of the longest path.
    """
    shared_dir(pairs.sparkSession)
    parts = 4 * pairs.sparkSession.sparkContext.defaultParallelism

    def star(edges: DataFrame, small: bool) -> DataFrame:
        both = edges if small else edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        out = both.join(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "u")
        if small:
            moved = out.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        else:  # of the two directions of a link one stays at most, so rows don't grow; repeats go in the small star
            moved = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.coalesce(parts).checkpoint()

    def stars(edges: DataFrame) -> bool:
        """Whether each node has one smaller neighbour, that has none itself: another round would change nothing."""
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        return ends.groupBy("n").agg(F.sum("up").alias("ups"), F.count("*").alias("of")).where("ups > 1 or ups = 1 and of > 1").isEmpty()

    edges = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().coalesce(parts).checkpoint()
    while not stars(edges):
        edges = star(star(edges, small=False), small=True)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def linked_roots(classes: DataFrame) -> DataFrame:
    """(node, root): the smallest fingerprint that can be reached by links of up to LIMIT bits, of the distinct fingerprints ``fp`` that have any."""
    classes, _ = written(classes, "simhash-distinct", thin=True)
    met = matched(classes)
    first, _ = written(components(to_least(met)), "simhash-stars", thin=True)
    rest = between(classes, met, first)
    at = lambda c: first.select(F.col("node").alias(f"_n_{c}"), F.col("root").alias(f"_r_{c}"))
    joined = rest.join(at("a"), F.col("a") == F.col("_n_a"), "left").join(at("b"), F.col("b") == F.col("_n_b"), "left")
    second = components(joined.select(F.coalesce("_r_a", "a").alias("a"), F.coalesce("_r_b", "b").alias("b"))).select(F.col("node").alias("_from"), F.col("root").alias("_to"))
    second, _ = written(second, "simhash-joined", thin=True)
    # The first links' members follow their root; roots and fingerprints without first links move themselves.
    members = first.join(second, F.col("root") == F.col("_from"), "left").select("node", F.coalesce("_to", "root").alias("root"))
    return members.unionByName(second.select(F.col("_from").alias("node"), F.col("_to").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (bigint), root (smallest fp of its component), component_id (smallest doc_id)."""
    fps, _ = written(fingerprints(docs, id_col, text_col), "simhash")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = linked_roots(classes.select("fp"))
    of = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of, _ = written(of, "simhash-classes", thin=True)
    groups = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.select("fp", "root").join(groups, "root")
    return fps.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id, once.

    Texts move once, to meet the list of ids that stay. Only ids that stand on several rows, and null ids,
    need a second look: there the smallest fingerprint of the component stays.
    """
    stay = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "root").agg(F.min("fp").alias("_keep"), F.count("*").alias("n"))
    stay, _ = written(stay, "simhash-stay", thin=True)
    clear = stay.groupBy("doc_id").agg(F.sum("n").alias("n")).where("n = 1 and doc_id is not null").select("doc_id")
    rows = docs.join(clear, "doc_id", "left_semi").select(*docs.columns)
    doubtful = stay.join(clear, "doc_id", "left_anti").select(F.col("doc_id").alias("_id"), "_keep")
    if doubtful.isEmpty():
        return rows
    again = docs.join(doubtful, F.col("doc_id").eqNullSafe(F.col("_id"))).withColumn("_fp", _fingerprints(text_of())).where("_fp = _keep")
    return rows.unionByName(again.dropDuplicates(["doc_id", "_fp"]).select(*docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
