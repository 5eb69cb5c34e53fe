import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from bahikhata.llm import ranges, sketches
from bahikhata.llm.common import table


def cut(text):
    """A text's passages, as a multiset."""
    raw, starts, lengths, _ = sketches.passages([(text or "").encode()])
    out = [raw[s:s + n].tobytes() for s, n in zip(starts, lengths)]
    assert b"".join(out) == (text or "").encode()
    return Counter(out)


def alike(a, b):
    a, b = cut(a), cut(b)
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 1.0


def held(docs):
    """The digest of docs against multisets of passages and plain slicing."""
    rows = docs.select("doc_id", "text").collect()
    got = sketches.digest(docs).collect()
    order = sorted(((-(1 << 63) if r.doc_id is None else r.doc_id, r.text or "") for r in rows))
    assert len({d for d, _ in order}) == len({x for x in order}), "one text an id here"
    want = []
    for i, (d, t) in enumerate(order):
        follow = order[(i + 1) % len(order)][1]
        edited = t[:len(t) - len(t) // 4] + follow[:len(t) // 4]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(alike(t, edited), 9), round(alike(t, follow), 9)))
    assert sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
    return got, dict(order)


def test_whole_table_against_multisets(spark, small):
    got, texts = held(table(spark, small, "documents"))
    of = {}
    for r in got:
        assert of.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(of.values())) == len(of) < len(got)
    long = [r for r in got if r.n_chars > 400]
    assert np.median([r.near_edited for r in long]) > 0.5 and np.median([r.near_next for r in long]) < 0.1
    assert sum(r.near_edited > r.near_next or r.near_next == 1 for r in got) > 0.98 * len(got)


@pytest.mark.parametrize("n", [1, 2, 7])
def test_odd_rows_in_any_number_of_ranges(spark, odd, monkeypatch, n):
    monkeypatch.setattr(sketches, "how_many", lambda rows: n)
    held(odd)


def test_small_tables(spark, odd, none):
    assert sketches.digest(none).count() == 0
    (row,) = sketches.digest(odd.where("doc_id = 6")).collect()
    assert row.near_next == 1.0 and row.doc_id == 6
    assert {r.near_next for r in sketches.digest(odd.where("doc_id in (3, 4)")).collect()} == {1.0}
    assert {(r.near_next, r.near_edited) for r in sketches.digest(odd.where("doc_id in (1, 3)")).collect() if r.doc_id == 3} == {(0.0, 1.0)}


def test_recovered_digests(spark):
    """Of differences of every size each digest comes back once with its side, repeats included."""
    rng = np.random.default_rng(5)
    sets = []
    for n, apart in ((0, 0), (0, 1), (5, 0), (40, 3), (40, 9), (500, 30), (3000, 2500), (1, 5000)):
        both = rng.integers(0, 1 << 63, n).astype(np.uint64)
        sets += [np.concatenate([both, rng.integers(0, 1 << 63, apart).astype(np.uint64)]), np.concatenate([both, rng.integers(0, 1 << 63, apart // 2).astype(np.uint64)])]
    sizes = np.array([len(s) for s in sets])
    first, second = np.arange(0, len(sets), 2), np.arange(1, len(sets), 2)
    pair, keys, side = sketches.differences(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), sizes, first, second)
    assert len({*zip(pair.tolist(), keys.tolist())}) == len(pair)
    for i, (a, b) in enumerate(zip(first, second)):
        mine = pair == i
        assert {*keys[mine & (side > 0)].tolist()} == {*sets[a].tolist()} - {*sets[b].tolist()}
        assert {*keys[mine & (side < 0)].tolist()} == {*sets[b].tolist()} - {*sets[a].tolist()}


def test_versions_name_what_changed(spark):
    random.seed(2)
    lines = [" ".join(random.choice(("al", "be", "ga", "dé", "ep")) + str(random.randrange(99)) for _ in range(random.randrange(1, 40))) for _ in range(300)]
    old = "\n".join(lines)
    new = "\n".join([*lines[:20], "an inserted line", *lines[20:200], lines[200] + " tail", *lines[203:], lines[3]])
    rows = [(1, old, new), (2, old, old), (3, None, "x"), (4, "", None), (5, "a" * 3000, "a" * 2900), (6, "same\nsame\nsame", "same\nsame")]
    got = {r.id: r for r in sketches.versions(spark.createDataFrame(rows, "id int, old string, new string")).collect()}
    for i, a, b in rows:
        gone, come = cut(a) - cut(b), cut(b) - cut(a)
        assert Counter(x.encode() for x in got[i].removed) == gone and Counter(x.encode() for x in got[i].added) == come
        assert got[i].likeness == pytest.approx(alike(a, b))
    assert "n inserted line\n" in "".join(got[1].added) and len(got[1].added) < 30 and got[2].likeness == 1.0


def test_first_keys_end_ranges_once(spark, odd):
    rows = sketches._followed(odd).collect()
    assert sum(r.extra == 0 for r in rows) == odd.count() and sum(r.extra for r in rows) >= 1
    assert ranges.how_many(odd) >= 1
