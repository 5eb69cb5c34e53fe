"""Mixing sources to target weights by a low-discrepancy schedule.

Sizes are words. A source's share of all words goes by its weight; a target stops at MOST times its source's
size and the excess is shared again by weight. Slot s of the schedule is the golden-ratio point frac((s + 1/2) * phi);
the source in whose stretch of the cumulative targets the point falls gets the slot, and its rank among the
slots of that source says which block of BLOCK words of the source's stream it takes. The stream is the source's
documents in the order of a hash, again and again, so a document is taken at most MOST times over. A source that
the points serve late gets its last blocks at the end of the schedule; the last block stops at the target.

Sources are rows, however many there are: their rank by name is a count over a range sort, targets come from one level for all (the target of a
source is its weight times the level, or MOST times its size), which running sums over the sorted ratios of size and weight give, and slots look their
source up in bins of equal width. The driver holds the level and three totals.

Cases: a null text has size 0 and is never taken; the null source is one source, the last; rows that repeat a doc_id
are documents of their own in the mix, and ``repeated`` gives them the same number of copies; rows alike in id, source and text
may swap places; an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bahikhata.llm.common import FILE_BYTES, WORD, fresh, running, text_of, with_numbers, with_offsets, written

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 2048
#: A number that all weights divide, so that size over weight is a whole number of its parts.
WEIGHTS_PRODUCT = 10
GOLDEN = 0.6180339887498949
#: Documents, and slots, that one running sum takes, about.
RANGE_ROWS = 50_000


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text_of()).alias("_text"), F.monotonically_increasing_id().alias("_row"))


def targets(source_sizes: dict[str | None, int], most: int = MOST) -> dict[str | None, Fraction]:
    """Exact targets: by code point, null last, WEIGHTS in turn, capped and reshared until none is above."""
    names = sorted((s for s in source_sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in source_sizes)
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    left, open_, out = Fraction(sum(source_sizes.values())), list(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / whole for s in open_}
        over = [s for s in open_ if share[s] > most * source_sizes[s]]
        if not over:
            out |= share
            break
        for s in over:
            out[s] = Fraction(most * source_sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in over]
    return out


def numbered_by(rows: DataFrame, order: list[Column], tag: str, out: str) -> DataFrame:
    """Adds ``out``: 0, 1 .. in the order of columns, over as many tasks as rows need. The rows are written."""
    kept, _ = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), tag, thin=True)
    return with_numbers(kept, [], out)


def level(sources: DataFrame, total: int, most: int = MOST) -> tuple[int, int]:
    """(a, b): the level a / b that a unit of weight gets. A source is capped if weight times level is over ``most`` times its size.

    ``sources`` has (size, weight). In the order of size over weight, the capped ones are those before the first at which what all before leave, shared
    by the weights of the rest, isn't above its own cap.
    """
    spread = WEIGHTS_PRODUCT / F.col("weight")
    keys = sources.groupBy((F.col("size") * spread).cast("decimal(38,0)").alias("ratio")).agg(F.sum("size").cast("decimal(38,0)").alias("sizes"), F.sum("weight").cast("decimal(38,0)").alias("weights"))
    weights = int(sources.agg(F.sum("weight")).first()[0] or 0)
    keys, _ = written(keys.repartitionByRange("ratio").sortWithinPartitions("ratio").withColumn("_row", F.monotonically_increasing_id()), "mixing-ratios", thin=True)
    part = lambda df: df.withColumn("_range", F.shiftright("_row", 33).cast("int"))
    keys = running(part(running(part(keys), [], "_row", "sizes", "before")), [], "_row", "weights", "taken")
    left, open_ = F.lit(total).cast("decimal(38,0)") - most * F.col("before"), F.lit(weights).cast("decimal(38,0)") - F.col("taken")
    fits = keys.where(WEIGHTS_PRODUCT * left <= most * F.col("ratio") * open_)
    row = fits.agg(F.min(F.struct("ratio", left.alias("a"), open_.alias("b"))).alias("z")).first()["z"]
    return (int(row["a"]), int(row["b"])) if row else (0, 1)


class Sources:
    """The sources of a mix as rows (k, _source, source_size, target, words, low), and their number and words in all."""

    def __init__(self, rows: DataFrame, number: int, words: int) -> None:
        self.rows, self.number, self.words = rows, number, words


def placed(docs: DataFrame) -> tuple[DataFrame, Sources]:
    """_row (unique), doc_id, source, size, k, source_size, target, words (of the source's target), from_word (its place in its source's stream); and the sources."""
    sized, _ = written(sizes(docs), "mixing-sizes", thin=True)
    every = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    named = numbered_by(every, [F.col("source").isNull(), F.col("source")], "mixing-sources", "k")
    named, _ = written(named.select(F.col("k").cast("long").alias("k"), "source", "size", "n", F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("k") % len(WEIGHTS)).cast("int")).alias("weight")), "mixing-named", thin=True)
    total, count, rows = named.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    a, b = level(named, total)
    whole = lambda x: F.lit(x).cast("decimal(38,0)")
    capped = F.col("weight") * whole(a) > MOST * F.col("size") * whole(b)
    named = named.withColumns({"words": F.when(capped, MOST * F.col("size")).otherwise(F.expr(f"cast(weight * cast({a} as decimal(30,0)) div cast({b} as decimal(30,0)) as bigint)")).cast("long"),
                               "target": F.when(capped, (MOST * F.col("size")).cast("double")).otherwise((F.col("weight") * whole(a)).cast("double") / F.lit(float(b)))})
    named, _ = written(numbered_sums(named), "mixing-targets", thin=True)
    dim = named.select("k", F.col("source").alias("_source"), F.col("size").alias("source_size"), "target", "words", "low")
    ordered = sized.join(dim.drop("low"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # Rows alike in id, source and text are told apart by a number.
    ordered = with_numbers(ordered.withColumn("_same", F.xxhash64("doc_id", "k", "_text")), ["_same"], "_number")
    numbered, _ = written(ordered.withColumn("_order", F.xxhash64("_same", "_number")).drop("_same", "_number", "_text"), "mixing-order", thin=True)
    stream = with_offsets(numbered, ["k"], "_order", "size", "from_word", max(8, -(-rows // RANGE_ROWS)))
    return stream, Sources(dim, count, int(named.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]))


def numbered_sums(named: DataFrame) -> DataFrame:
    """Adds low: the words of the sources before, in the order of k."""
    return running(named.withColumn("_range", F.floor(F.col("k") / RANGE_ROWS).cast("int")), [], "k", "words", "low")


def schedule(spark: SparkSession, sources: Sources, block: int = BLOCK) -> DataFrame:
    """(slot, k, rank, source_size, words): the slots that each source gets, ranked; every source has enough for its target.

    A slot's point times the words of all is a place in their cumulative targets. Places are cut into bins of equal width, many more than a source or
    two would fill, so that slots spread; a source stands in each bin that it reaches into, and a slot looks only into its own.
    """
    n = -(-sources.words // block)
    live = sources.rows.where("words > 0").select("k", "source_size", "words", "low")
    bins = max(1024, sources.number)
    width = -(-max(1, sources.words) // bins)
    point = (F.col("id") + 0.5) * GOLDEN
    place = F.least(F.floor((point - F.floor(point)) * sources.words), F.lit(max(0, sources.words - 1))).cast("long")
    chunk = RANGE_ROWS
    slots = spark.range(n).select(F.col("id").alias("slot"), F.floor(F.col("id") / chunk).alias("chunk"), place.alias("place")).withColumn("bin", F.floor(F.col("place") / width))
    stands = live.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("low") + F.col("words") - 1) / width))))
    slots = slots.join(stands, "bin").where("place >= low and place < low + words").select("slot", "chunk", "k", "source_size", "words")
    # Written, so that no plan holds the lookup of slots more than once: the driver's memory grows with the exchanges of a plan.
    sums, _ = written(slots.groupBy("k", "chunk").agg(F.count("*").alias("n")), "mixing-slot-counts", thin=True)
    before = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("k").alias("_k"), F.col("chunk").alias("_chunk"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("k", "chunk").orderBy("slot")
    ranked = slots.withColumn("inside", F.row_number().over(inside) - 1)
    ranked = ranked.join(base, (F.col("k") == F.col("_k")) & (F.col("chunk") == F.col("_chunk"))).select("slot", "k", (F.col("base") + F.col("inside")).alias("rank"), "source_size", "words")
    got = sums.groupBy(F.col("k").alias("_k")).agg(F.sum("n").alias("got"))
    due = F.floor((F.col("words") + block - 1) / block)
    late = (live.join(got, F.col("k") == F.col("_k"), "left").withColumn("got", F.coalesce("got", F.lit(0))).withColumn("due", due).where("due > got")
            .select("k", "source_size", "words", F.explode(F.sequence(F.col("got"), F.col("due") - 1)).alias("rank"))
            .select((F.lit(n) + F.col("rank") * sources.number + F.col("k")).alias("slot"), "k", "rank", "source_size", "words"))
    return ranked.unionByName(late)


def takings(placed_docs: DataFrame, sources: Sources, block: int = BLOCK) -> DataFrame:
    """(slot, epoch, k, _row, words): what each slot takes of each document that its block holds."""
    slots = schedule(placed_docs.sparkSession, sources, block).withColumnRenamed("source_size", "whole")
    begin, end = F.col("rank") * block, F.least((F.col("rank") + 1) * block, F.col("words"))
    slots = slots.where(begin < F.col("words")).withColumn("begin", begin).withColumn("end", end)
    slots = slots.withColumn("epoch", F.explode(F.sequence(F.floor(F.col("begin") / F.col("whole")), F.floor((F.col("end") - 1) / F.col("whole")))))
    zero = F.col("epoch") * F.col("whole")
    slots = slots.select("slot", "k", "epoch", (F.greatest("begin", zero) - zero).alias("u"), (F.least("end", zero + F.col("whole")) - zero).alias("v"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / block), F.floor((b - 1) / block)))
    slots = slots.withColumn("cell", cells(F.col("u"), F.col("v")))
    docs = placed_docs.where("size > 0").select("k", "_row", F.col("from_word").alias("a"), (F.col("from_word") + F.col("size")).alias("b"))
    docs = docs.withColumn("cell", cells(F.col("a"), F.col("b")))
    edge = F.col("cell") * block
    met = F.least("b", "v", edge + block) - F.greatest("a", "u", edge)
    return docs.join(slots, ["k", "cell"]).withColumn("words", met).where("words > 0").select("slot", "epoch", "k", "_row", "words")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, from_word, words (of the source's target), one row a document."""
    stream, sources = placed(docs)
    stream, _ = written(stream, "mixing-stream", thin=True)
    taken = takings(stream, sources).groupBy("_row").agg(F.sum("words").alias("taken"))
    return stream.join(taken, "_row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))


def repeated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in the order of the schedule, whole, as often as the mix takes over half of one: 0 to MOST times.

    A row stands at the first slot that takes of it; rows of one partition are in order, and partitions are stretches of slots.
    """
    spark = docs.sparkSession
    stream, sources = placed(docs)
    stream, _ = written(stream, "mixing-stream", thin=True)
    each = takings(stream, sources).groupBy("_row", "epoch").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    each = each.join(stream.select("_row", "doc_id", "size"), "_row").where(2 * F.col("words") > F.col("size"))
    # Rows that share a doc_id share what most copies of one of them are.
    most = each.groupBy("_row", "doc_id").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    most = most.groupBy("doc_id").agg(F.max_by("slots", F.struct(F.size("slots"), F.transform("slots", lambda x: -x))).alias("slots"))
    id_, slot = fresh(docs, "_mix_id"), fresh(docs, "_mix_slot")
    rows = docs.join(most.select(F.col("doc_id").alias(id_), F.col("slots").alias(slot)), F.col("doc_id").eqNullSafe(F.col(id_))).drop(id_).withColumn(slot, F.explode(slot))
    slots = max(1, sources.words // BLOCK + 1)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = int(min(slots, max(4 * spark.sparkContext.defaultParallelism, size // FILE_BYTES)))
    part = F.least(F.floor(F.col(slot) * n / slots), F.lit(n - 1)).cast("int")
    return rows.repartitionById(n, part).sortWithinPartitions(slot, "doc_id").select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")
