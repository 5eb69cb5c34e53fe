"""Quality rules: base rules, then robust outliers by minimum covariance determinant per language and source.

All of it is DataFrame and SQL expressions. Each text gives the base counts and a vector of four transformed
statistics. Rows that pass the base rules are grouped by language and source; a group of under GROUP rows is judged
by the model of all rows of its language, and a language of under GROUP rows by the model of the whole table.

Vectors are counted once by cell of a grid of STEP floors a side (one pre-aggregated shuffle, so a hot source costs no
more than its cells), and all estimates are made of cells and their counts. Of each group STARTS sets of the SHARE of its
rows nearest to the medians are taken, by six measures that use medians and median absolute deviations. From each,
concentration steps go on until no determinant falls any more: mean and covariance of the set, distances by
them, the SHARE of rows with the smallest. The set of the least determinant is the group's model. FLOORS squared is
added to each covariance's diagonal (the regularised form of the estimate), so that a statistic that is constant in a
group doesn't reject the rest, and MAD is never under its floor.

A row whose squared Mahalanobis distance, scaled so that the group's median distance is that of a chi-square with four
degrees, passes CUTOFF is rejected. Models are a row a group; they go to the rows, which never move by group.

Cases: null or empty text: all counts 0, base_failed; null lang or source: a group of its own; texts of any
length are counted whole; repeated rows count each and are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bahikhata.llm.common import WORD, text_of, written

#: Rows that a model needs. Four means and ten covariances of under fifty rows shift too much with a few bad ones.
GROUP = 50
#: So many groups' models are broadcast (under 40 MB); there can't be more than a group for GROUP rows and level.
BROADCAST = 100_000
SHARE = 0.75
#: Concentration steps between two looks at the determinants.
LOOK = 3
#: Smallest spread of each statistic that can reject: it is a standard deviation, in the statistic's unit.
FLOORS = (0.08, 0.6, 0.12, 0.15)
#: Cells a floor: a row moves by an eighth of a floor at most, which adds under a hundredth to a variance.
STEP = 4
#: Median of chi-square with four degrees of freedom; and the rejection point. Normal rows pass it once in 23 million, and the
#: statistics have longer tails than normal ones.
MEDIAN, CUTOFF = 3.3567, 40.0
P = len(FLOORS)
X, Y = [f"x{i}" for i in range(P)], [f"y{i}" for i in range(P)]
WHITE = r"[\x20\x09-\x0D]+"


def _repeated_words(words: Column) -> Column:
    """Words that lie in a five-word window found twice or more in the text (windows compared by 64-bit hashes)."""
    n = F.size(words)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(5)]))
    return hashes, windows, n


def counts(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); _docs: the columns of ``carry``."""
    text = F.col("_text")
    held = [F.struct(*carry).alias("_docs")] if carry else []
    rows = docs.select("doc_id", "lang", "source", text_of().alias("_text"), *held)
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    hashes, windows, _ = _repeated_words(F.col("_w"))
    rows = rows.withColumn("_w", words).withColumn("_n", F.size("_w")).withColumn("_h", hashes)
    rows = rows.withColumn("_v", F.when(F.col("_n") >= 5, windows))
    doubled = F.col("_v").isNotNull() & (F.size(F.array_distinct("_v")) < F.size("_v"))
    # Only where a window repeats: sort (hash, place), keep the places whose hash also stands beside them, and
    # add up what each covers: five words, less what the next one covers too.
    placed = F.array_sort(F.transform("_v", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_s", F.when(doubled, placed))
    at = F.filter(F.transform("_s", lambda x, j: F.when((x["h"] == F.get("_s", j - 1)["h"]) | (x["h"] == F.get("_s", j + 1)["h"]), x["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("_p", F.sort_array(at))
    covered = F.aggregate(F.transform("_p", lambda i, j: F.least(F.lit(5), F.coalesce(F.get("_p", j + 1) - i, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return rows.select(
        "doc_id", "lang", "source", F.col("_n").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, WHITE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), *(["_docs"] if carry else []))


def statistics(rows: DataFrame) -> DataFrame:
    """Adds base_failed and the vector: symbols a word (log), word length, shares of repeated words and lines."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    # A short text's shares are noisy; they are drawn to zero, and its word length to the usual, by weight n / (n + 20).
    trust = n / (n + 20)
    return (rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
            .withColumn("x0", F.log1p(10 * F.col("n_symbols") / n) / F.log(F.lit(10.0)) * trust)
            .withColumn("x1", (F.least(F.col("word_chars") / n, F.lit(40.0)) - 5) * trust)
            .withColumn("x2", F.sqrt(F.col("n_repeat_words") / n) * trust)
            .withColumn("x3", F.sqrt(F.col("n_dup_lines") / (n / 10 + 1)) * trust))


def _cholesky(cov: list[list[Column]]) -> list[list[Column]]:
    """Lower triangular factor, written out: P is fixed and small."""
    low: list[list[Column]] = []
    for i in range(P):
        low.append([])
        for j in range(i + 1):
            rest = cov[i][j]
            for k in range(j):
                rest = rest - low[i][k] * low[j][k]
            low[i].append(F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / low[j][j])
    return low


def _squared(values: list[Column], mean: list[Column], low: list[list[Column]]) -> Column:
    """Squared Mahalanobis distance by the Cholesky factor of the covariance."""
    total, solved = F.lit(0.0), []
    for i in range(P):
        rest = values[i] - mean[i]
        for k in range(i):
            rest = rest - low[i][k] * solved[k]
        solved.append(rest / low[i][i])
        total = total + solved[i] * solved[i]
    return total


def cells(passed: DataFrame) -> DataFrame:
    """lang, source, y0 .. (whole numbers of grid steps), n: the rows of each cell."""
    grid = [F.round(F.col(x) * (STEP / FLOORS[i])).cast("long").alias(y) for i, (x, y) in enumerate(zip(X, Y))]
    return passed.select("lang", "source", *grid).groupBy("lang", "source", *Y).agg(F.count("*").alias("n"))


def _key(level: str, *of: str) -> Column:
    """A group's name; to_json leaves nulls out, so that null is unlike any string."""
    return F.to_json(F.struct(F.lit(level).alias("level"), *of))


def grouped(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (group, y0 .., n, all) of every group that has GROUP rows, and of the whole table; and lang, source, group: who is judged by which."""
    pair = counted.groupBy("lang", "source").agg(F.sum("n").alias("of_pair"))
    lang = counted.groupBy("lang").agg(F.sum("n").alias("of_lang"))
    pair = pair.join(lang.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
    judge = pair.select("lang", "source", F.when(F.col("of_pair") >= GROUP, _key("pair", "lang", "source")).when(F.col("of_lang") >= GROUP, _key("lang", "lang")).otherwise(_key("table")).alias("group"))
    counted = counted.withColumn("group", F.explode(F.array(_key("pair", "lang", "source"), _key("lang", "lang"), _key("table"))))
    joined = counted.groupBy("group", *Y).agg(F.sum("n").alias("n"))
    return joined.withColumn("all", F.sum("n").over(Window.partitionBy("group"))).join(judge.select("group").distinct(), "group", "left_semi"), judge


def _middle(values: DataFrame, out: str) -> DataFrame:
    """group, i, and of (group, i, v, n) the smallest v at which half of the rows are reached."""
    upto = Window.partitionBy("group", "i").orderBy("v")
    sums = values.groupBy("group", "i", "v").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("group", "i")))
    return sums.where(2 * F.col("upto") >= F.col("all")).groupBy("group", "i").agg(F.min("v").alias(out))


def _centres(grid: DataFrame) -> DataFrame:
    """group, m0 .. (medians), r0 .. (median absolute deviations, a floor at least)."""
    long = grid.select("group", "n", F.posexplode(F.array(*Y)).alias("i", "v"))
    middle = _middle(long, "m")
    spread = _middle(long.join(middle, ["group", "i"]).select("group", "i", F.abs(F.col("v") - F.col("m")).alias("v"), "n"), "r")
    both = middle.join(spread, ["group", "i"])
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    return both.groupBy("group").agg(*[pick("m", i).alias(f"m{i}") for i in range(P)], *[F.greatest(1.4826 * pick("r", i), F.lit(float(STEP))).alias(f"r{i}") for i in range(P)])


def _starts(grid: DataFrame) -> DataFrame:
    """grid with (start, d): six first measures of distance from the medians."""
    off = [F.abs(F.col(y) - F.col(f"m{i}")) / F.col(f"r{i}") for i, y in enumerate(Y)]
    total = sum((o * o for o in off), F.lit(0.0))
    # All statistics, the largest of them, and each alone with a trace of the others for order.
    measures = [total, F.greatest(*off), *[o + total * 1e-3 for o in off]]
    tried = grid.join(_centres(grid), "group").select(*grid.columns, F.posexplode(F.array(*measures)).alias("start", "d"))
    return tried


def _models(tried: DataFrame) -> DataFrame:
    """group, start, all, m0 .., l00 .. (Cholesky factor), det: of the SHARE of each set's rows with the smallest d."""
    nearest = Window.partitionBy("group", "start").orderBy("d", *Y)
    want = F.ceil(SHARE * F.col("all"))
    tried = tried.withColumn("left", want - (F.sum("n").over(nearest) - F.col("n"))).where("left > 0").withColumn("w", F.least("n", "left"))
    # Whole numbers, so that the order of adding can't change a bit.
    sums = tried.groupBy("group", "start").agg(F.max("all").alias("all"), F.sum("w").alias("n"), *[F.sum(F.col("w") * F.col(y)).alias(f"s{i}") for i, y in enumerate(Y)],
                                               *[F.sum(F.col("w") * F.col(Y[i]) * F.col(Y[j])).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)])
    mean = [F.col(f"s{i}") / F.col("n") for i in range(P)]
    model = sums.select("group", "start", "all", *[m.alias(f"m{i}") for i, m in enumerate(mean)], *[
        (F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j] + float(STEP ** 2 if i == j else 0)).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)])
    low = _cholesky([[F.col(f"c{i}{j}") for j in range(i + 1)] for i in range(P)])
    model = model.select("group", "start", "all", *[f"m{i}" for i in range(P)], *[low[i][j].alias(f"l{i}{j}") for i in range(P) for j in range(i + 1)])
    return model.withColumn("det", sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(P)), F.lit(0.0)))


def _far(values: list[Column]) -> Column:
    """Squared distance of a point in grid steps by the model in its row."""
    return _squared(values, [F.col(f"m{i}") for i in range(P)], [[F.col(f"l{i}{j}") for j in range(i + 1)] for i in range(P)])


def models(grid: DataFrame) -> DataFrame:
    """group, start, m0 .., l00 .., det, scale: the model of the least determinant of each group."""
    at = F.array(*[F.col(y).cast("double") for y in Y])
    found = _models(_starts(grid))
    before = None
    while True:
        found, _ = written(found, "outlier-models", thin=True)
        # The sum of all log determinants falls with every step that changes a set, until none does.
        now = found.agg(F.sum("det")).first()[0]
        if now is None or (before is not None and before - now <= 1e-9 * max(1.0, abs(before))):
            break
        before = now
        for _ in range(LOOK):
            held = found.select("group", "start", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)])
            found = _models(grid.join(held, "group").select(*grid.columns, "start", _far([F.get(at, i) for i in range(P)]).alias("d")))
    best = found.groupBy("group").agg(F.min_by(F.struct(*found.columns[1:]), F.struct("det", "start")).alias("b")).select("group", "b.*").drop("all")
    far = grid.join(best, "group").select("group", "n", F.lit(0).alias("i"), _far([F.get(at, i) for i in range(P)]).alias("v"))
    # A group whose median is under the expected is all within the floors: its distances stay as they are.
    scale = _middle(far, "d").select("group", F.greatest(F.lit(1.0), F.col("d") / MEDIAN).alias("scale"))
    return best.join(scale, "group")


def judged(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance; ``carry``: columns of docs that are kept in _docs."""
    rows, _ = written(statistics(counts(docs, carry)), "outlier-statistics")
    wanted = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    counted, _ = written(cells(rows.where(~F.col("base_failed"))), "outlier-cells", thin=True)
    grid, judge = grouped(counted)
    grid, _ = written(grid, "outlier-grid", thin=True)
    by, _ = written(judge.join(models(grid), "group").withColumnRenamed("lang", "_l").withColumnRenamed("source", "_s"), "outlier-judges", thin=True)
    few = F.broadcast if by.count() <= BROADCAST else (lambda x: x)
    values = [F.col(x) * (STEP / FLOORS[i]) for i, x in enumerate(X)]
    far = F.when(~F.col("base_failed"), _far(values) / F.col("scale"))
    out = rows.join(few(by), F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("distance", far)
    return out.select(*wanted, F.coalesce(F.col("distance") <= CUTOFF, F.lit(False)).alias("kept"), "distance", *(["_docs"] if carry else []))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay; each row is judged by itself, and its columns travel with its statistics."""
    return judged(docs, docs.columns).where("kept").select("_docs.*")


def digest(docs: DataFrame) -> DataFrame:
    return judged(docs)
