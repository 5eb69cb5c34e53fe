"""Amounts and balances of recognised pages that were misread, put right by the running balance."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bahikhata.operators.stages import kept

#: A misread digit may change an amount by less than this, in hundredths; places of the order that a stretch spans; and rows at its end that vote on its last balance.
SWING, STRETCH, VOTERS = 100_000, 1 << 18, 24


def recovered(amount: int, implied: int) -> bool:
    """Whether two amounts in hundredths differ in one character only and by less than SWING."""
    if implied <= 0 or abs(implied - amount) >= SWING:
        return False
    a, b = (f"{x // 100}.{x % 100:02d}" for x in (amount, implied))
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1


def step(running: int | None, debit: int | None, credit: int | None, balance: int | None) -> tuple[int | None, int | None, int | None, str]:
    """(debit, credit, balance, repaired) of a row behind a running balance; what is repaired is "", "amount" or "balance"."""
    if running is None or balance is None:
        return debit, credit, balance, ""
    expected = running + (credit or 0) - (debit or 0)
    if abs(expected - balance) <= 1:
        return debit, credit, balance, ""
    moved = balance - running
    if credit is not None and recovered(credit, moved):
        return debit, moved, balance, "amount"
    if credit is None and debit is not None and recovered(debit, -moved):
        return -moved, credit, balance, "amount"
    return debit, credit, expected, "balance"


def voted(rows: list[tuple]) -> int | None:
    """The balance that most of the rows (debit, credit, balance), each taken as right, lead to at the last."""
    ends: Counter = Counter()
    for i, (_, _, running) in enumerate(rows):
        for debit, credit, balance in rows[i + 1:]:
            running = step(running, debit, credit, balance)[2]
        ends[running] += 1
    return max(ends, key=ends.get)


def repaired(txns: DataFrame, openings: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(file, row, debit, credit, balance, repaired) of transactions (file, row, debit, credit, balance), given (file, opening).

    Row after row the balance before a row, as put right, and its amount say what its balance should be. If another is printed and one digit of the amount
    explains it, the amount was misread; else the balance was, and the expected one goes on. A file is cut into stretches that run apart, each behind the
    balance printed before it. That may be misread, and then all of the stretch is wrong and so is its end; so those run again whose printed balance isn't the one that the rows
    before them vote for. Where the stretch before still ends on another balance, it runs again behind that, until none changes: as many times as
    stretches that an error that can't be explained runs through. A run again writes its own stretches only.

    A row without a balance, or behind one, is left alone, and so are rows before the first balance of a file without an opening.
    """
    cents = lambda c: F.round(F.col(c) * 100).cast("long").alias(c)
    rows = kept(txns.select("file", F.col("row").cast("long").alias("row"), F.floor(F.col("row") / stretch).alias("stretch"), *[cents(c) for c in ("debit", "credit", "balance")]))
    order = Window.partitionBy("file").orderBy("stretch")
    kind = "file string, stretch long, row long, debit long, credit long, balance long, repaired string"
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (f.split() for f in kind.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Behind the rows of a stretch comes one without a number, whose balance is the voted one.
        now, running, tail = None, None, deque(maxlen=VOTERS)
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(schema), schema.types)], schema=schema)
        for some in batches:
            out = []
            for file, part, row, debit, credit, balance, carried in zip(*[c.to_pylist() for c in some.columns]):
                if now != (file, part):
                    if now:
                        out.append((*now, None, None, None, voted(list(tail)), ""))
                    now, running = (file, part), carried
                    tail.clear()
                tail.append((debit, credit, balance))
                done = step(running, debit, credit, balance)
                running = done[2]
                out.append((file, part, row, *done))
            yield batch(out)
        if now:
            yield batch([(*now, None, None, None, voted(list(tail)), "")])

    # A stretch begins behind what the row before it shows: its balance, or nothing.
    ends = rows.groupBy("file", "stretch").agg(F.max_by(F.struct("balance"), "row")["balance"].alias("end"))
    first = openings.select("file", F.round(F.col("opening") * 100).cast("long").alias("opening"))

    def carried(ends: DataFrame) -> DataFrame:
        before = ends.withColumns({"_n": F.row_number().over(order), "_end": F.lag("end").over(order)}).join(first, "file", "left")
        return before.select("file", "stretch", F.when(F.col("_n") == 1, F.col("opening")).otherwise(F.col("_end")).alias("carried"))

    def changed(now: DataFrame, given: DataFrame) -> DataFrame:
        return kept(now.join(given.withColumnRenamed("carried", "_was"), ["file", "stretch"]).where(~F.col("carried").eqNullSafe(F.col("_was"))).drop("_was"))

    given = kept(carried(ends))
    todo, runs, ends = given, [], None
    while True:
        some = rows.join(todo, ["file", "stretch"]).repartition("file", "stretch").sortWithinPartitions("file", "stretch", "row").select("file", "stretch", "row", "debit", "credit", "balance", "carried")
        runs.append(kept(some.mapInArrow(run, kind).withColumn("run", F.lit(len(runs)))))
        got = runs[-1].groupBy("file", "stretch", "run").agg(F.max_by(F.struct("balance"), "row")["balance"].alias("end"), F.max(F.when(F.col("row").isNull(), F.col("balance"))).alias("vote"))
        ends = kept(got if ends is None else ends.join(todo, ["file", "stretch"], "left_anti").unionByName(got))
        if len(runs) == 1:
            now = kept(carried(ends.select("file", "stretch", F.col("vote").alias("end"))))
            todo, given = changed(now, given), now
            if not todo.isEmpty():
                continue
        now = kept(carried(ends.select("file", "stretch", "end")))
        todo, given = changed(now, given), now
        if todo.isEmpty():
            break
    done = reduce(DataFrame.unionByName, runs).where("row is not null").join(ends.select("file", "stretch", "run"), ["file", "stretch", "run"])
    money = lambda c: (F.col(c) / 100).cast("decimal(18,2)").alias(c)
    return done.select("file", "row", *[money(c) for c in ("debit", "credit", "balance")], "repaired")
