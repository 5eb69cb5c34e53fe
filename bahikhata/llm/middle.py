"""Fill-in-the-middle arrangements of texts, and the way back, in Spark's own functions.

A text is cut into units (a word with the white space before it; white space at the end is a unit of its own). A hash of the row's id
gives two cuts between units and the form: ``psm`` is prefix, suffix, middle, ``spm`` is suffix, prefix, middle, each part behind
its sentinel; ``plain`` leaves the text alone. A text that holds a sentinel is always plain, so parsing an arrangement at its sentinels is exact: a sentinel
begins with the only "<" in it, so none can arise where a part and a sentinel meet.

Cases: a null text counts as empty; an empty text is plain with no unit; texts of white space have one unit; a null id hashes as
no digits; rows that repeat an id repeat its cuts; a text of any length is one row, cut in linear time; columns are replaced by name in ``arranged``'s
result only, which holds its own ones and those asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bahikhata.llm.common import text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are arranged, and of a hundred of those so many with the suffix first.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42
#: The white space is possessive: nothing but white space can follow what it leaves, so giving back never helps.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SENTINEL = "<[PSM]>"


def draws(key: Column, seed: int = SEED, n: int = 4) -> list[Column]:
    """``n`` numbers under 2 ** 32 from the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def arranged(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """key, text, n, form, prefix, middle, suffix, output: the parts are null where the form is plain."""
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    h1, h2, h3, h4 = draws(F.col("key"), seed)
    plain = (F.col("text") == "") | F.col("text").rlike(SENTINEL) | (h3 % 100 >= rate)
    rows = rows.select("key", "text", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("units"), h1.alias("h1"), h2.alias("h2"),
                       F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm").alias("form"))
    ends = [(F.col(h) % (F.size("units") + 1)).cast("int") for h in ("h1", "h2")]
    rows = rows.select("key", "text", "form", "units", F.size("units").cast("long").alias("n"), F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    cut = F.col("form") != "plain"
    part = lambda start, length: F.when(cut, F.array_join(F.slice("units", start, length), ""))
    rows = rows.select("key", "text", "n", "form", part(F.lit(1), F.col("a")).alias("prefix"), part(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"),
                       part(F.col("b") + 1, F.col("n").cast("int") - F.col("b")).alias("suffix"))
    p, s, m = ((F.lit(mark), F.col(name)) for mark, name in ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")))
    return rows.withColumn("output", F.when(F.col("form") == "psm", F.concat(*p, *s, *m)).when(F.col("form") == "spm", F.concat(*s, *p, *m)).otherwise(F.col("text")))


def restored(output: Column, form: Column) -> Column:
    """The text behind an arrangement: what stands between its sentinels, put in order."""
    parts = F.split(output, SENTINEL, -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    rows = arranged(docs)
    sha = lambda c: F.sha2(c, 256)
    return rows.select(F.col("key").alias("doc_id"), "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
                       sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
