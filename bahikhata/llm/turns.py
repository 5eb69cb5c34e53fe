"""Repair of conversations whose turns are lost, emptied, repeated, cut off or in the wrong role.

A repaired conversation's roles are nothing, or one system turn at most and then pairs of user and assistant. Each turn is kept (price
0), given the other role (REROLE) or deleted (DELETE), empty turns are inserted (INSERT), and a turn that stays although it breaks off costs BROKEN more; blank
turns and repeats must go. ``paths`` finds the cheapest edits as a retained subsequence: for each role of the last retained turn it holds the least price less the
deletions up to here (a prefix sum), so a gap costs the difference of two sums; the pair of roles on both sides of a gap says how many turns
are inserted in it; equal prices are told apart by the audit, the string of the edits' initials (D, I, K, R), of which the ASCII-least
stays. No two audits over the same turns and to the same role begin one another, so the least of a whole is made of the least of its parts,
and parts can be worked out apart.

A conversation of any length spreads: rows are dealt into ranges of (conversation, turn, role, text). A conversation that lies inside one range and
part is repaired where it lies. Others are kept as parts of PART_ROWS rows: repeats are found by a grouping with partial minima, each part gives
its prices from every role to every role, one pass over the parts of a conversation joins them (a few numbers a part), and each part
then writes its own text. What the hash of a whole text needs in order, the finished texts, is streamed part by part.

Cases: a null role or text counts as one space, so does a null id or turn in the hash that picks the damage; null ids are one conversation; null
turns come first; rows of one turn stand by role, then text; a role of another initial can't be kept; equal rows are repeats; conversations of which nothing is left
have no row in ``repaired`` and one of zeros in the digest; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bahikhata.llm.common import written
from bahikhata.llm.ranges import as_array, byte_batches, firsts, how_many, range_of

REROLE, DELETE, INSERT, BROKEN = 3, 4, 3, 3
#: Rows and characters of a part.
PART_ROWS, PART_CHARS = 2000, 4 << 20
#: Characters of a text that ranges are cut by; texts alike so far stay in one range.
HEAD = 32
_SOLID, _END = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_NAMES = {"s": "system", "u": "user", "a": "assistant"}
#: Turns that are inserted between two retained roles; "" is where a conversation begins, and in _CLOSE where it ends.
_GAP = {("", "s"): 0, ("", "u"): 0, ("s", "u"): 0, ("a", "u"): 0, ("u", "a"): 0, ("u", "u"): 1, ("", "a"): 1, ("s", "a"): 1, ("a", "a"): 1}
_CLOSE = {"": 0, "a": 0, "u": 1, "s": 2}
STATES = ("", "s", "u", "a")


def paths(turns: str, role: str = "") -> dict[str, tuple[int, str]]:
    """The price and audit of the cheapest edits of ``turns`` behind a retained ``role``, for each role that can be retained last.

    A character a turn: x for one that must go, else the initial of its role, o for others, in capitals if the turn breaks off.
    """
    best, paid = {role: (0, "")}, 0
    for t in turns:
        kept: dict[str, tuple[int, str]] = {}
        if t != "x":
            extra = BROKEN if t.isupper() else 0
            ways = [(r, REROLE, "R") for r in "ua" if r != t.lower()] + ([(t.lower(), 0, "K")] if t.lower() in "sua" else [])
            for before, (price, audit) in best.items():
                for after, cost, letter in ways:
                    inserts = _GAP.get((before, after))
                    if inserts is not None:
                        way = (price + cost + extra + INSERT * inserts - DELETE, audit + "I" * inserts + letter)
                        kept[after] = min(kept.get(after, way), way)
        paid += DELETE
        # What was retained before gets one deletion more, which the prefix sum has already.
        gaps = {r: (price, audit + "D") for r, (price, audit) in best.items()}
        best = {r: min(x for x in (gaps.get(r), kept.get(r)) if x) for r in {*gaps, *kept}}
    return {r: (price + paid, audit) for r, (price, audit) in best.items()}


@lru_cache(100_000)
def cheapest(turns: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return min((price + INSERT * _CLOSE[r], audit + "I" * _CLOSE[r]) for r, (price, audit) in paths(turns).items())


def applied(audit: str, rows: list[tuple[str, str]], last: str = "") -> tuple[list[str], str]:
    """The lines of the repaired turns, and the last of their roles; ``last`` is the role before them."""
    out, at = [], 0
    for i, letter in enumerate(audit):
        if letter in "IR":
            last = "a" if last == "u" else "u"
            out.append(f"{_NAMES[last]}:{rows[at][1] if letter == 'R' else ''}")
        elif letter == "K":
            last = rows[at][0][:1]
            out.append(f"{rows[at][0]}:{rows[at][1]}")
        at += letter != "I"
    return out, last


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: some rows lost, emptied, without marks at sentences' ends, repeated or said by the user."""
    blank = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    which = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])) % 20
    rows = rows.withColumn("_way", which).where("_way > 0")
    text = F.when(F.col("_way") == 1, "").when(F.col("_way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("_way") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("_copy", F.explode(F.when(F.col("_way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_way", "_copy")


def _faults(rows: list[tuple[str, str]], first: list[bool]) -> tuple[str, int, int, int]:
    """The characters for ``paths``, and the counts of blank, repeated and broken-off turns."""
    out, blank, same, broken = [], 0, 0, 0
    for (role, text), new in zip(rows, first):
        mark = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not _SOLID.search(text):
            blank, mark = blank + 1, "x"
        elif not new:
            same, mark = same + 1, "x"
        elif not _END.search(text):
            broken, mark = broken + 1, mark.upper()
        out.append(mark)
    return "".join(out), blank, same, broken


def _illegal(initials: list[str]) -> int:
    return sum(pair not in (("s", "u"), ("u", "a"), ("a", "u")) for pair in zip(initials, initials[1:]))


def _counts(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    real = {t for t in turns if t is not None}
    return (min(real), max(real), len(real)) if real else (None, None, 0)


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PART = "block int, part int, turns array<long>, roles array<string>, texts array<string>"


def _whole(conv: int | None, turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    seen, first = set(), []
    for r in rows:
        first.append(r not in seen)
        seen.add(r)
    marks, blank, same, broken = _faults(rows, first)
    low, high, distinct = _counts(turns)
    cost, audit = cheapest(marks) if len(marks) <= 64 else cheapest.__wrapped__(marks)
    lines = applied(audit, rows)[0]
    return (conv, min(_MOST, high - low + 1 - distinct) if distinct else 0, blank, same, broken, _illegal([r[:1] for r, _ in rows]), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _columns(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def _dealt(rows: DataFrame) -> DataFrame:
    """A row for each conversation that lies in one place, with its result, and one for each part of the others, with its turns."""
    keys = lambda df: df.select(F.coalesce("conv_id", F.lit(_LEAST)).alias("c"), F.coalesce("turn", F.lit(_LEAST)).alias("t"), "role", F.left("text", F.lit(HEAD)).alias("head"))
    bounds = firsts(keys(rows), how_many(rows))
    key = F.struct(F.coalesce("conv_id", F.lit(_LEAST)).alias("c"), F.coalesce("turn", F.lit(_LEAST)).alias("t"), "role", F.left("text", F.lit(HEAD)).alias("head"))
    block = range_of(key, as_array(bounds, keys(rows)), len(bounds)) if bounds else F.lit(0)
    edges = [b[0] for b in bounds]
    schema = _columns(f"{_RESULT}, {_PART}")
    done, cut = len(_columns(_RESULT)), len(_columns(_PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size, now, part = [], [], 0, None, 0

        def ended(more: bool) -> None:
            nonlocal held, size, part
            if held:
                turns, said = [h[0] for h in held], [h[1:] for h in held]
                block, conv = now
                edge = _LEAST if conv is None else conv
                if more or part or edge == edges[block] or edge == (edges[block + 1] if block + 1 < len(edges) else None):
                    out.append((conv, *[None] * (done - 1), block, part, turns, [r for r, _ in said], [t for _, t in said]))
                else:
                    out.append((*_whole(conv, turns, said), *[None] * cut))
            held, size, part = [], 0, part + 1 if more else 0

        for rows in batches:
            for block, conv, turn, role, text in zip(*[c.to_pylist() for c in rows.columns]):
                if now != (block, conv):
                    ended(False)
                    now = (block, conv)
                elif len(held) >= PART_ROWS or size >= PART_CHARS:
                    ended(True)
                held.append((turn, role, text))
                size += len(text)
                if len(out) >= 500 or out and out[-1][done] is not None:
                    yield _batch(out, schema)
                    out = []
        ended(False)
        yield _batch(out, schema)

    byte_batches(rows.sparkSession)
    n = max(1, len(bounds))
    placed = rows.select(block.cast("int").alias("block"), "conv_id", "turn", "role", "text").repartitionById(n, F.col("block")).sortWithinPartitions("block", "conv_id", "turn", "role", "text")
    return placed.mapInArrow(run, f"{_RESULT}, {_PART}")


def _first_said(parts: DataFrame) -> DataFrame:
    """(conv_id, block, part, new): the places in a part of the turns whose role and text stand in none before."""
    said = parts.select("conv_id", "block", "part", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "z"))
    said = said.select("conv_id", F.md5("z.roles").alias("r"), F.md5("z.texts").alias("t"), F.struct("block", "part", "i").alias("at"))
    least = said.groupBy("conv_id", "r", "t").agg(F.min("at").alias("at")).select("conv_id", "at.*")
    return least.groupBy("conv_id", "block", "part").agg(F.collect_list("i").alias("new"))


def _in_order(df: DataFrame) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")


def _joined_parts(parts: DataFrame) -> DataFrame:
    """The results of conversations that lie in several parts."""
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["block"] == b["block"]) & (a["part"] == b["part"])
    new = _first_said(parts)
    marked, _ = written(parts.join(new, same(parts, new), "left").select(parts["*"], F.coalesce("new", F.array().cast("array<int>")).alias("new")), "turns-parts")
    facts = "conv_id long, block int, part int, low long, high long, distinct long, blank long, same long, broken long, illegal long, first string, last string, ways array<long>"
    steps = "conv_id long, block int, part int, before string, after string, closes int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    texts = "conv_id long, block int, part int, audit string, lines long, text string"
    ends = "conv_id long, audit string, repaired_sha256 string"
    fact_schema, step_schema, text_schema, end_schema = map(_columns, (facts, steps, texts, ends))

    def rows_of(rows: pa.RecordBatch) -> Iterator[tuple]:
        for i in range(rows.num_rows):
            r = {name: rows.column(name)[i].as_py() for name in rows.schema.names}
            said = list(zip(r["roles"], r["texts"]))
            new = set(r["new"])
            yield r, said, _faults(said, [k in new for k in range(len(said))])

    def stated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r, said, (marks, blank, same, broken) in rows_of(rows):
                ways = []  # for each role before and after: the price and the place of its audit among those with the same role before
                for before in STATES:
                    found = paths(marks, before)
                    order = sorted(found, key=lambda x, found=found: found[x][1])
                    for after in STATES:
                        ways += [found[after][0], order.index(after)] if after in found else [-1, -1]
                initials = [x[:1] for x in r["roles"]]
                yield _batch([(r["conv_id"], r["block"], r["part"], *_counts(r["turns"]), blank, same, broken, _illegal(initials), initials[0], initials[-1], ways)], fact_schema)

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each part the roles before and after it, on its first row of them the numbers of the conversation."""
        conv, some = None, False
        best: dict = {}
        back: list = []
        sums: dict = {}

        def closed() -> Iterator[tuple]:
            # Audits of different roles never begin one another, so what closes them doesn't change their order.
            end = min(best, key=lambda r: (best[r][0] + INSERT * _CLOSE[r], best[r][1]))
            gaps = min(_MOST, sums["high"] - sums["low"] + 1 - sums["distinct"]) if sums["distinct"] else 0
            total = (gaps, sums["blank"], sums["same"], sums["broken"], sums["illegal"], best[end][0] + INSERT * _CLOSE[end])
            for i, (block, part, came) in enumerate(reversed(back)):
                after, end = end, came[end]
                yield (conv, block, part, end, after, int(i == 0), *(total if i == 0 else [None] * 6))

        for rows in batches:
            out = []
            for r in rows.to_pylist():
                if not some or r["conv_id"] != conv:
                    if some:
                        out += closed()
                    conv, some, best, back = r["conv_id"], True, {"": (0, 0)}, []
                    sums = {"low": None, "high": None, "distinct": 0, "blank": 0, "same": 0, "broken": 0, "illegal": 0, "last": None}
                step: dict = {}
                for i, before in enumerate(STATES):
                    if before in best:
                        price, rank = best[before]
                        for j, after in enumerate(STATES):
                            cost, place = r["ways"][8 * i + 2 * j: 8 * i + 2 * j + 2]
                            if cost >= 0:
                                way = (price + cost, (rank, place), before)
                                step[after] = min(step.get(after, way), way)
                order = sorted(step, key=lambda x: step[x][1])
                back.append((r["block"], r["part"], {x: step[x][2] for x in step}))
                best = {x: (step[x][0], order.index(x)) for x in step}
                sums["distinct"] += r["distinct"] - (r["distinct"] > 0 and r["low"] == sums["high"])
                sums["low"] = r["low"] if sums["low"] is None else sums["low"]
                sums["high"] = sums["high"] if r["high"] is None else r["high"]
                for name in ("blank", "same", "broken", "illegal"):
                    sums[name] += r[name]
                if sums["last"] is not None:
                    sums["illegal"] += _illegal([sums["last"], r["first"]])
                sums["last"] = r["last"]
            yield _batch(out, step_schema)
        yield _batch(list(closed()) if some else [], step_schema)

    byte_batches(parts.sparkSession)
    ways, _ = written(_in_order(marked.mapInArrow(stated, facts)).mapInArrow(through, steps), "turns-ways", thin=True)
    way = ways.select("conv_id", "block", "part", "before", "after", "closes")
    finished = marked.join(way, same(marked, way)).select(marked["*"], "before", "after", "closes")

    def wrote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r, said, (marks, *_) in rows_of(rows):
                audit = paths(marks, r["before"])[r["after"]][1] + ("I" * _CLOSE[r["after"]] if r["closes"] else "")
                lines = applied(audit, said, r["before"])[0]
                yield _batch([(r["conv_id"], r["block"], r["part"], audit, len(lines), "\n".join(lines))], text_schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, some, audit, digest, empty = None, False, [], hashlib.sha256(), True
        for rows in batches:
            out = []
            for r in rows.to_pylist():
                if not some or r["conv_id"] != conv:
                    if some:
                        out.append((conv, "".join(audit), digest.hexdigest()))
                    conv, some, audit, digest, empty = r["conv_id"], True, [], hashlib.sha256(), True
                audit.append(r["audit"])
                if r["lines"]:
                    digest.update((r["text"] if empty else "\n" + r["text"]).encode())
                    empty = False
            yield _batch(out, end_schema)
        yield _batch([(conv, "".join(audit), digest.hexdigest())] if some else [], end_schema)

    told = _in_order(finished.mapInArrow(wrote, texts)).mapInArrow(hashed, ends)
    total = ways.where("closes = 1")
    return total.join(told, total["conv_id"].eqNullSafe(told["conv_id"])).select(total["conv_id"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of conversations (conv_id, turn, role, text) without nulls in role and text."""
    dealt, _ = written(_dealt(rows), "turns")
    whole = dealt.where("block is null").select(*_columns(_RESULT).names)
    parts = dealt.where("block is not null").select("conv_id", *_columns(_PART).names)
    return whole.unionByName(_joined_parts(parts))


def digest(conversations: DataFrame) -> DataFrame:
    ids = conversations.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    found = repaired(damaged(conversations))
    rows = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(F.col("_id").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
