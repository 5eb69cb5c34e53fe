import hashlib
import itertools
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from bahikhata.llm import ranges, turns
from bahikhata.llm.common import table

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def brute(marks):
    """(cost, audit) by a search from the end: all edits of the rest, the cheapest and of those the least."""
    @lru_cache(None)
    def rest(i, state, inserted):
        found = []
        if i == len(marks) and state in ("", "a"):
            found.append((0, ""))
        moves = []  # (letter, price, next row, next state)
        if inserted < 3:
            moves += [("I", 3, i, r) for r in "ua"]
        if i < len(marks):
            moves.append(("D", 4, i + 1, state))
            if marks[i] != "x":
                broken = 3 * marks[i].isupper()
                moves += [("R", 3 + broken, i + 1, r) for r in "ua"] + ([("K", broken, i + 1, marks[i].lower())] if marks[i] not in "oO" else [])
        for letter, price, j, after in moves:
            if letter != "D" and (state, after) not in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                continue
            more = rest(j, after, inserted + 1 if letter == "I" else 0)
            if more:
                found.append((price + more[0], letter + more[1]))
        return min(found, default=None)
    return rest(0, "", 0)


def plain(rows):
    """The contract's results by loops, of original rows (conv_id, turn, role, text)."""
    convs, out = {}, {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        kept += [(turn is not None, turn or 0, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    for conv, kept in convs.items():
        kept.sort()
        real = [t for some, t, _, _ in kept if some]
        gaps = max(real) - min(real) + 1 - len(set(real)) if real else 0
        marks, seen, n = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in kept:
            mark = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not text.strip(SPACE):
                mark, n["blank"] = "x", n["blank"] + 1
            elif (role, text) in seen:
                mark, n["duplicate"] = "x", n["duplicate"] + 1
            elif text.rstrip(SPACE)[-1] not in ".!?":
                mark, n["truncated"] = mark.upper(), n["truncated"] + 1
            seen.add((role, text))
            marks += mark
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        cost, audit = brute(marks)
        lines, at, roles = [], 0, ""
        for letter in audit:
            if letter in "IR":
                role = "assistant" if roles.endswith("u") else "user"
                lines.append(f"{role}:{kept[at][3] if letter == 'R' else ''}")
                roles += role[0]
            elif letter == "K":
                lines.append(f"{kept[at][2]}:{kept[at][3]}")
                roles += kept[at][2][0]
            at += letter != "I"
        assert re.fullmatch("(s?(ua)+)?", roles)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def test_cheapest_edits_against_search():
    for n in range(5):
        for marks in itertools.product("suaoxUA", repeat=n):
            assert turns.cheapest("".join(marks)) == brute("".join(marks))
    for marks in ("sxuUaauxsosuA", "uuuuuuaaaaaa", "oooOOOxxxuausasu", "SSSUUUAAA"):
        assert turns.cheapest(marks) == brute(marks)


def test_whole_table_against_loops(spark, small):
    rows = table(spark, small, "conversations")
    assert got(turns.digest(rows)) == plain([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])


ROLES, TEXTS = ("user", "assistant", "system", "tool", "", None), ("Yes.", "No", "", " \t", "Well! ", None, "a?\n", "Yes.")


def mixed_rows(convs, n):
    return [(c, (i * 7 + (c or 0)) % n if i % 11 else None, ROLES[(i * i + (c or 3)) % 6 if i % 3 else i % 2], f"{TEXTS[(i + i // 5) % 8]}" if i % 4 and TEXTS[(i + i // 5) % 8] is not None else (None if i % 4 else f"t{i}.")) for c in convs for i in range(n)]


def test_odd_conversations(spark):
    """Nulls in every column, ties, repeats, foreign roles, and an extra column that clashes."""
    rows = mixed_rows([None, 1, 2, 3, 4, 5], 23) + [(9, None, None, None), (10, 5, "user", "Hi."), (10, 5, "user", "Hi."), (11, -(1 << 63), "user", "A."), (11, (1 << 63) - 1, "user", "B.")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, cost int")
    want = plain(rows)
    want[11] = ((1 << 63) - 1 if want[11][0] > 1 << 62 else want[11][0], *want[11][1:])
    assert got(turns.digest(df)) == want
    assert turns.digest(df.where("false")).count() == 0


@pytest.mark.parametrize("part_rows", [1, 3, 2000])
def test_long_conversations_in_parts(spark, monkeypatch, part_rows):
    """Parts give what the whole gives, wherever they are cut."""
    monkeypatch.setattr(turns, "PART_ROWS", part_rows)
    rows = mixed_rows([7, 8], 150)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert got(turns.digest(df)) == plain(rows)


def test_nothing_left(spark):
    lost = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, lost, "user", "x")], "conv_id long, turn long, role string, text string")
    assert got(turns.digest(df)) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_ranges_hold_every_key_once(spark):
    keys = spark.range(1000).select((F.col("id") % 97).alias("a"), F.concat(F.lit('k"'), (F.col("id") % 13).cast("string")).alias("b"))
    bounds = ranges.firsts(keys, 7)
    rows = keys.select("a", "b", ranges.range_of(F.struct("a", "b"), ranges.as_array(bounds, keys), len(bounds)).alias("r")).collect()
    assert all(r.r == sum(b <= (r.a, r.b) for b in bounds) - 1 for r in rows) and len({r.r for r in rows}) == len(bounds) > 2
    assert ranges.firsts(keys.where("false"), 7) == []
