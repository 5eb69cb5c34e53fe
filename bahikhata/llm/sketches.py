"""Document fingerprints that subtract: invertible Bloom lookup sketches of a text's passages.

A text's passages are its lines, cut further where a rolling hash of the last bytes says so (more often in short lines), so an edit moves only the
cuts beside it and in its own line. A passage's digest is a 64-bit hash of its bytes and of how many equal ones stood before it. A sketch has three rows of cells; a digest goes to one cell
of each, which holds the number, the xor of the digests and the xor of their checks. The sketch of one version minus that of another keeps only what differs:
a cell that holds one digest gives it away (its check proves it), taking it out lays others bare, and so on (peeling). Where that stops short the
sketches are too small for the difference, and both are made anew GROWTH times as large, until it comes out. The likeness of two texts is the share
of passages that both have among those that either has, all counted from the recovered difference: exact, whatever the size.

``fingerprint`` is the smallest sketch, in base 64, behind the number of passages. Sizes double from the number of passages alone, so
a text's fingerprint depends on nothing but the text.

For the edited texts every document must meet the next one by id: rows are dealt into ranges of (id, hash), the first row of a range also goes
to the end of the range before, and a task streams its range in order, holding a few megabytes.

Cases: a null text counts as empty and has no passage; two empty texts are alike (1.0), an empty and another are not (0.0); null ids count as the least id;
rows of one id stand by a hash of their text, then by the text, and equal ones follow each other; one document is followed by itself; a text of any length is
one row; of other columns none is read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bahikhata.llm.common import text_of
from bahikhata.llm.ranges import BATCH_BYTES, as_array, byte_batches, firsts, how_many, range_of

#: Cells of the smallest sketch (three rows), how much larger the next one is, and rounds of peeling before it is taken.
CELLS, GROWTH, ROUNDS = 12, 4, 500
#: Bytes that decide about a cut; one place in how many is one, in lines of under SHORT bytes and in others; the most bytes of a passage.
WINDOW, CUT_SHORT, CUT_ONE_IN, SHORT, LONGEST = 4, 8, 32, 128, 128
_LEAST = -(1 << 63)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A permutation of 64-bit numbers whose bits all depend on all."""
    x = x + np.uint64(salt * int(_ODD) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(raw, starts, lengths, item): the bytes of all texts together, and each passage's place, length and text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = len(raw)
    if not n:
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    rolled = np.zeros(n, np.uint32)
    for k in range(min(WINDOW, n)):
        rolled[k:] += raw[:n - k].astype(np.uint32) * np.uint32(pow(0x01000193, k + 1, 1 << 32))
    rolled ^= rolled >> np.uint32(15)
    rolled = rolled * np.uint32(0x2C1B3C6D) >> np.uint32(12)
    lines = raw == 10
    lines[ends[sizes > 0] - 1] = True
    width = np.diff(np.flatnonzero(lines), prepend=-1)
    cut = (rolled % np.uint32(CUT_ONE_IN) == 0) | (rolled % np.uint32(CUT_SHORT) == 0) & np.repeat(width < SHORT, width) | lines
    # No cut where the bytes that decide began in the text before.
    begins = (ends - sizes)[sizes > 0]
    for k in range(WINDOW - 1):
        near = begins + k
        cut[near[near < n]] = False
    # A passage ends before the first byte of a character.
    cut[:-1] &= (raw[1:] & 0xC0) != 0x80
    cut |= lines
    after = np.flatnonzero(cut) + 1
    starts = np.concatenate([[0], after[:-1]])
    lengths = after - starts
    if lengths.max() > LONGEST:
        parts = -(-lengths // LONGEST)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        whole = np.repeat(starts + lengths, parts)
        starts = np.repeat(starts, parts) + step * LONGEST
        lengths = np.minimum(whole - starts, LONGEST)
    return raw, starts, lengths, np.searchsorted(ends, starts, "right")


def digests(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The passages' digests, different also for repeats inside a text."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(int(lengths.max()), 0xD6E8FEB86659FD93, np.uint64))
    place = np.arange(len(raw)) - np.repeat(starts, lengths)
    sums = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * powers[place], starts)
    found = _mixed(sums + lengths.astype(np.uint64) * _ODD)
    order = np.lexsort((found, item))
    same = np.zeros(len(order), bool)
    same[1:] = (found[order][1:] == found[order][:-1]) & (item[order][1:] == item[order][:-1])
    if same.any():
        runs = np.arange(len(order))
        nth = runs - np.maximum.accumulate(np.where(same, 0, runs))
        again = nth > 0
        found[order[again]] = _mixed(found[order[again]] + nth[again].astype(np.uint64) * _ODD)
    return found


def _cells(keys: np.ndarray, row: np.ndarray, cells: int) -> list[np.ndarray]:
    """The three places of each digest in sketches of ``cells`` cells that stand one behind another."""
    third = cells // 3
    return [row * cells + j * third + (_mixed(keys, j + 1) % np.uint64(third)).astype(np.int64) for j in range(3)]


def _check(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 7) >> np.uint64(32)).astype(np.uint32)


def sketches(keys: np.ndarray, row: np.ndarray, rows: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, key, check), each of (rows, cells), of the digests of each row."""
    count, key, check = np.zeros(rows * cells, np.int32), np.zeros(rows * cells, np.uint64), np.zeros(rows * cells, np.uint32)
    checks = _check(keys)
    for at in _cells(keys, row, cells):
        count += np.bincount(at, minlength=rows * cells).astype(np.int32)
        np.bitwise_xor.at(key, at, keys)
        np.bitwise_xor.at(check, at, checks)
    return count.reshape(rows, cells), key.reshape(rows, cells), check.reshape(rows, cells)


def peeled(count: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(done, row, digest, side) of subtracted sketches: which came out whole, and what was recovered (side 1 of the first, -1 of the second)."""
    rows, cells = count.shape
    count, key, check = count.ravel().copy(), key.ravel().copy(), check.ravel().copy()
    found = []
    for _ in range(ROUNDS):
        one = np.flatnonzero(np.abs(count) == 1)
        one = one[_check(key[one]) == check[one]]
        if not len(one):
            break
        row = one // cells
        _, first = np.unique(_mixed(key[one] + row.astype(np.uint64) * _ODD), return_index=True)
        one, row = one[first], row[first]
        keys, side = key[one], count[one]
        found.append((row, keys, side))
        checks = _check(keys)
        for at in _cells(keys, row, cells):
            np.subtract.at(count, at, side)
            np.bitwise_xor.at(key, at, keys)
            np.bitwise_xor.at(check, at, checks)
    done = ~((count != 0) | (key != 0) | (check != 0)).reshape(rows, cells).any(axis=1)
    row, keys, side = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32))
    return done, row, keys, side


def differences(keys: np.ndarray, item: np.ndarray, sizes: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, side) of every digest that one of a pair of items has and the other hasn't; ``item`` rises."""
    ends = np.cumsum(sizes)
    # The difference is as large as that of the numbers at least, so smaller sketches than that can't hold it.
    cells = np.full(len(first), CELLS, np.int64)
    while (short := cells < np.abs(sizes[first] - sizes[second])).any():
        cells[short] *= GROWTH
    out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32))]
    while (open_ := cells > 0).any():
        size = int(cells[open_].min())
        pairs = np.flatnonzero(cells == size)
        # As many pairs at once as sketches of bounded size hold.
        for some in np.array_split(pairs, max(1, len(pairs) * size // (1 << 19))):
            items, back = np.unique(np.concatenate([first[some], second[some]]), return_inverse=True)
            spans = [np.arange(ends[i] - sizes[i], ends[i]) for i in items]
            at = np.concatenate(spans) if spans else np.zeros(0, np.int64)
            made = sketches(keys[at], np.repeat(np.arange(len(items)), sizes[items]), len(items), size)
            a, b = back[:len(some)], back[len(some):]
            done, row, got, side = peeled(made[0][a] - made[0][b], made[1][a] ^ made[1][b], made[2][a] ^ made[2][b])
            whole = done[row]
            out.append((some[row[whole]], got[whole], side[whole]))
            cells[some] = np.where(done, 0, size * GROWTH)
    return tuple(np.concatenate(x) for x in zip(*out))


def _keyed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, starts, lengths, item = passages(texts)
    return digests(raw, starts, lengths, item), item, np.bincount(item, minlength=len(texts))


def fingerprints(keys: np.ndarray, item: np.ndarray, sizes: np.ndarray) -> list[str]:
    count, key, check = sketches(keys, item, len(sizes), CELLS)
    return [base64.b64encode(b"".join((int(n).to_bytes(4, "little"), a.astype("<i4").tobytes(), b.astype("<u8").tobytes(), c.astype("<u4").tobytes()))).decode() for n, a, b, c in zip(sizes, count, key, check)]


def likeness(sizes: np.ndarray, first: np.ndarray, second: np.ndarray, pair: np.ndarray) -> np.ndarray:
    both, apart = sizes[first] + sizes[second], np.bincount(pair, minlength=len(first))
    return np.where(both + apart == 0, 1.0, (both - apart) / np.maximum(1, both + apart))


def versions(df: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """df with ``removed`` and ``added``, the passages that only the old or the new text has, in order, and ``likeness``."""
    kind = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, removed array<string>, added array<string>, likeness double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            n = rows.num_rows
            texts = [(t or "").encode() for c in (old, new) for t in rows.column(c).to_pylist()]
            raw, starts, lengths, item = passages(texts)
            keys, sizes = digests(raw, starts, lengths, item), np.bincount(item, minlength=2 * n)
            first, second = np.arange(n), np.arange(n, 2 * n)
            pair, found, side = differences(keys, item, sizes, first, second)
            apart = [({*found[(pair == i) & (side > 0)].tolist()}, {*found[(pair == i) & (side < 0)].tolist()}) for i in range(n)]
            said: list[list[str]] = [[] for _ in texts]
            for k, s, size, i in zip(keys.tolist(), starts.tolist(), lengths.tolist(), item.tolist()):
                if k in apart[i % n][i // n]:
                    said[i].append(raw[s:s + size].tobytes().decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(said[:n], pa.list_(pa.string())), pa.array(said[n:], pa.list_(pa.string())), pa.array(likeness(sizes, first, second, pair))], [*rows.schema.names, "removed", "added", "likeness"])

    byte_batches(df.sparkSession)
    return df.mapInArrow(run, kind)


def _followed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, extra) in order in each task; behind the last row comes the first of the next task, as ``extra``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.select("doc_id", "text", F.struct(F.coalesce("doc_id", F.lit(_LEAST)).alias("id"), F.xxhash64("text").alias("hash")).alias("key"))
    keys = rows.select("key.*")
    bounds = firsts(keys, how_many(docs))
    n = max(1, len(bounds))
    at = as_array(bounds, keys)
    rows = rows.withColumn("block", range_of(F.col("key"), at, len(bounds)))
    # The first row of a range also follows the last of the range before, and the very first the very last.
    here, before = F.struct("block", F.lit(0).alias("extra")), F.struct(((F.col("block") + n - 1) % n).alias("block"), F.lit(1).alias("extra"))
    twice = F.coalesce(F.get(at, F.col("block")) == F.col("key"), F.lit(False))
    rows = rows.withColumn("to", F.explode(F.when(twice, F.array(here, before)).otherwise(F.array(here)))).select("to.*", "key", "doc_id", "text")
    return rows.repartitionById(n, F.col("block")).sortWithinPartitions("extra", "key", "text").select("doc_id", "text", "extra")


_KIND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: each document against itself with its end replaced, and against the next one by id."""
    def compared(rows: list[tuple[int | None, str]], last: str) -> pa.RecordBatch:
        texts = [t for _, t in rows] + [last]
        edited = [t[:len(t) - len(t) // 4] + texts[i + 1][:len(t) // 4] for i, (_, t) in enumerate(rows)]
        n = len(rows)
        raw = [t.encode() for t in (*texts, *edited)]
        keys, item, sizes = _keyed(raw)
        prints = fingerprints(keys, item, sizes)
        first, second = np.tile(np.arange(n), 2), np.concatenate([np.arange(n + 1, 2 * n + 1), np.arange(1, n + 1)])
        near = likeness(sizes, first, second, differences(keys, item, sizes, first, second)[0])
        return pa.RecordBatch.from_arrays([
            pa.array([d for d, _ in rows], pa.int64()), pa.array([len(t) for _, t in rows], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw[n + 1:]], pa.string()),
            pa.array(prints[:n], pa.string()), pa.array(prints[n + 1:], pa.string()), pa.array(near[:n]), pa.array(near[n:])], [c.split()[0] for c in _KIND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size = 0
        for rows in batches:
            for doc_id, text, extra in zip(*[c.to_pylist() for c in rows.columns]):
                if held and (extra or size >= BATCH_BYTES // 2):
                    yield compared(held, text)
                    held, size = [], 0
                if not extra:
                    held.append((doc_id, text))
                    size += len(text)
        if held:
            raise RuntimeError("rows changed between two readings: a range has no successor")

    byte_batches(docs.sparkSession)
    return _followed(docs).mapInArrow(run, _KIND)
