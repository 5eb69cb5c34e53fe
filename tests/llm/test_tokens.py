import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bahikhata.llm import packing, token_files
from bahikhata.llm.tokens import crc_of, dropped_space, kept_space, public

MAKERS = {"word_bpe_49k.json": dropped_space, "byte_bpe_50k.json": kept_space}
SIGNS = st.text(alphabet="ab Z,.!&'\n\té́ß中²_1<|endoftext|>~\x01 Σ", max_size=40)


def whole(name, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public(name))
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", MAKERS)
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(SIGNS, max_size=4))
def test_cut_texts_have_the_ids_of_whole_texts(name, texts):
    encode = MAKERS[name](public(name))
    got = encode(pa.array([*texts, None], pa.string()))
    assert [x.tolist() for x in got] == [list(np.frombuffer(encode.whole(t), encode.kind)) for t in texts] + [[]]


@pytest.mark.parametrize("name", MAKERS)
def test_ids_are_the_tokenizers(name):
    text = "It's a test, isn't it? Yes: 12 34.\nÀ l'école!! && done."
    assert MAKERS[name](public(name))(pa.array([text]))[0].tolist() == whole(name, text)


@pytest.mark.parametrize("name", MAKERS)
def test_a_worker_gives_the_tokenizer_few_pieces_at_once(name, monkeypatch):
    encode = type(MAKERS[name](public(name)))(public(name))
    given, split = [], encode.split
    monkeypatch.setattr(encode, "split", lambda pieces, *rest: given.append(len(pieces)) or split(pieces, *rest))
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = " ".join(a + b + c + d for a in letters for b in letters for c in letters for d in "xyz")
    assert encode(pa.array([text]))[0].tolist() == whole(name, text)
    assert sum(given) > 50_000 and max(given) <= 10_000


@given(st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_coding_round_trip(values):
    ranks = np.array(values, np.uint32)
    assert token_files.decoded(*token_files.coded(ranks), len(ranks)).tolist() == values


def test_token_files_against_brute_force(spark, odd):
    rows = token_files.digest(odd, public("word_bpe_49k.json")).collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, crc_of(np.array(whole("word_bpe_49k.json", r.text or "") + [2]))) for r in odd.collect())
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in rows)
    assert got == want
    ends = sorted((r.start, r.start + r.n_tokens) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_a_folder_is_read_by_itself(spark, odd, tmp_path):
    folder = token_files.write_files(odd, public("word_bpe_49k.json"), f"file://{tmp_path}/ids")
    rows = token_files.read_files(spark.newSession(), folder).collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, whole("word_bpe_49k.json", r.text or "") + [2]) for r in odd.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    import pyarrow.parquet as pq
    order = [-1 if d is None else d for f in sorted((tmp_path / "ids" / "blocks").glob("*.parquet")) for ids in pq.read_table(f).column("doc_ids").to_pylist() for d in ids]
    assert order == sorted(order) and len(order) == len(want)


def test_ids_of_any_width():
    class Rows:
        def mapInPandas(self, run, schema):
            return run

    ids = [[70_000, 1], [2], [99_999] * 3]
    import pandas as pd
    rows = pd.DataFrame({"shard": 0, "doc_id": [1, 2, 3], "ids": [np.array(x, "<u4").tobytes() for x in ids]})
    (block,) = [b for b in token_files.blocks(Rows(), np.arange(100_000, dtype=np.uint32), "<u4")([rows]) if len(b)]
    assert token_files.decoded(block.control[0], block.data[0], 6).tolist() == sum(ids, [])


def test_repeated_ids_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 40)
    rows = [(7, f"word {i}") for i in range(40)] + [(None, f"none {i}") for i in range(30)] + [(i, "a b c") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cuts = token_files.bounds(docs)
    assert cuts[1].max() > 2 and cuts[2] > 2
    got = token_files.digest(docs, public("word_bpe_49k.json")).collect()
    ends = sorted((r.start, r.start + r.n_tokens, -1 if r.doc_id is None else r.doc_id) for r in got)
    assert len(got) == 90 and ends[0][0] == 0 and all(a[1] == b[0] and a[2] <= b[2] for a, b in zip(ends, ends[1:]))
    where = token_files.encoded(docs, public("word_bpe_49k.json"), cuts).groupBy("doc_id").agg({"shard": "max"}).collect()
    assert len(where) == 21


def test_packing_against_brute_force(spark, odd):
    parts, places = packing.packed(odd, public("byte_bpe_50k.json"))
    rows = places.collect()
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    docs = {6: next(r.text for r in odd.collect() if r.doc_id == 6)}
    ids = np.array(whole("byte_bpe_50k.json", docs[6]) + [0], "<u4")
    mine = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == 6)
    assert sum(x[1] for x in mine) == len(ids) and all(crc_of(ids[a:a + n]) == c for a, n, c in mine)
    assert sum(r.length for r in rows) == sum(len(whole("byte_bpe_50k.json", r.text or "")) + 1 for r in odd.collect())
    sizes = {r.sequence_id: len(r.ids) // 2 for r in packing.sequences(parts, places).collect()}
    assert sizes == {k: sum(n for _, n in v) for k, v in filled.items()}


def test_keys_stay_unique_in_compacted_tables(spark, odd):
    many = odd.repartition(60)
    parts, places = packing.packed(many, public("byte_bpe_50k.json"))
    assert parts.count() == parts.select("piece").distinct().count()
    assert sum(r.length for r in places.collect()) == sum(len(whole("byte_bpe_50k.json", r.text or "")) + 1 for r in odd.collect())


def test_repeats_use_no_more_than_there_is():
    rng = np.random.default_rng(1)
    histogram = np.append(0, rng.integers(0, 50, 1023))
    combos = packing.combinations()
    counts = packing.repeats(histogram, combos, rounds=40)
    used = np.zeros(1024, np.int64)
    np.add.at(used, combos.ravel(), np.repeat(counts, 3))
    assert (used[1:] <= histogram[1:]).all() and used[1:].sum() > 0.8 * histogram.sum()


def test_empty_tables(none):
    assert token_files.digest(none, public("word_bpe_49k.json")).count() == 0
    assert packing.digest(none, public("byte_bpe_50k.json")).count() == 0
