import os
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_operators import brute_components, brute_counts, brute_fingerprint

import corpus_pipeline
from bahikhata.llm import classifier, common, mixing, outliers
from bahikhata.llm.common import table
from bahikhata.llm.tokens import public


def test_each_stage_against_brute_force(spark, small):
    """Every stage works on all that the last one kept; what each keeps is worked out again in plain Python, models aside."""
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "quality_rules", "simhash_near_dedup", "source_mixing", "packing"]
    docs = table(spark, small, "documents")
    given = [tuple(r) for r in docs.collect()]
    text = {r[0]: r[1] or "" for r in given}

    model = classifier.learned(docs, table(spark, small, "labels"))
    good = stages["quality_classifier"](spark, docs, small).cache()
    scores = model.scores(np.array([classifier.features(text[r[0]]) for r in given]))
    assert good.columns == docs.columns and Counter(map(tuple, good.collect())) == Counter(r for r, s in zip(given, scores) if round(s, 9) >= classifier.THRESHOLD)

    ruled = stages["quality_rules"](spark, good, small).cache()
    rows = [tuple(r) for r in ruled.collect()]
    judged = {r.doc_id: r for r in outliers.digest(good).collect()}
    base = {d: (c := brute_counts(text[d]))[0] < 10 or 100 * c[4] > 20 * c[0] for d in judged}
    assert ruled.columns == docs.columns and len(judged) == good.count() and all(judged[d].base_failed == failed for d, failed in base.items())
    assert sorted(r[0] for r in rows) == sorted(d for d, r in judged.items() if not base[d] and r.distance <= outliers.CUTOFF)

    single = stages["simhash_near_dedup"](spark, ruled, small).cache()
    rows.sort()
    parts = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows])
    assert sorted(map(tuple, single.collect())) == [r for r, c in zip(rows, parts) if r[0] == c]

    mixed = stages["source_mixing"](spark, single, small).cache()
    sizes = {r[0]: brute_counts(r[1])[0] for r in single.collect()}
    sums = Counter()
    for r in single.collect():
        sums[r.source] += sizes[r.doc_id]
    want = mixing.targets(dict(sums))
    copies = Counter(tuple(r) for r in mixed.collect())
    assert mixed.columns == docs.columns and set(copies) <= set(map(tuple, single.collect())) and max(copies.values()) <= mixing.MOST
    taken = Counter()
    for r, n in copies.items():
        taken[r[3]] += n * sizes[r[0]]
    assert all(abs(taken[s] - float(t)) <= max(sizes.values()) for s, t in want.items())

    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(public("byte_bpe_50k.json"))
    tokens.encode_special_tokens = True
    pieces = stages["packing"](spark, mixed, small).collect()
    wanted = Counter()
    for r, n in copies.items():
        wanted[r[0]] += n * (len(tokens.encode(r[1] or "", add_special_tokens=False).ids) + 1)
    held = Counter()
    for r in pieces:
        held[r.doc_id] += r.length
    assert held == wanted


def test_run_leaves_no_tables_of_earlier_stages(spark, tmp_path, small, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    for name in ("documents", "labels"):
        table(spark, small, name).where("doc_id < 60").write.parquet(f"{tmp_path}/in/{name}.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}/in")
    assert out.agg(F.sum("length")).first()[0] > 0
    left = [x for x in os.listdir(f"{tmp_path}/tables") if x.startswith("pipeline-") or not x.startswith("p")]
    assert [x for x in left if x.startswith("pipeline-")] == [x for x in left if x.startswith("pipeline-source_mixing")]
    assert not any(x.startswith(("outlier", "mixing", "simhash")) for x in left)


def test_pipeline_of_odd_rows(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("none", none)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        assert {r.doc_id for r in rows} <= {1, None} and (rows or name == "none")
