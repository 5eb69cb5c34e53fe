import hashlib
import re

from bahikhata.llm import middle
from bahikhata.llm.common import table

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by hand."""
    text, h = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return n, form, len(p), len(m), out


def held(spark, df):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = df.select("doc_id", "text").collect()
    want = []
    for r in rows:
        n, form, a, b, out = plain(r.doc_id, r.text)
        want.append((r.doc_id, n, form, a, b, sha(out), sha(r.text or "")))
    assert sorted(map(repr, map(tuple, middle.digest(df).collect()))) == sorted(map(repr, want))
    return {w[2] for w in want}


def test_whole_table_by_hand(spark, small):
    assert held(spark, table(spark, small, "documents")) == {"plain", "spm", "psm"}


def test_odd_rows(spark, odd, none):
    held(spark, odd)
    assert middle.digest(none).count() == 0


def test_texts_near_sentinels(spark):
    texts = ["<", "<P", "P> a <S", "a<P>b", "<<P> x", " <M>", "S> <M", "\n\n", "x \n", " y", "   ", "𝒳 <\n>", "a <  " + "\t" * 50_000]
    df = spark.createDataFrame([(i * 100 + k, t) for i, t in enumerate(texts) for k in range(20)], "doc_id long, text string")
    assert held(spark, df) == {"plain", "spm", "psm"}
    arranged = middle.arranged(df, rate=100)
    rows = arranged.select("text", "form", middle.restored(arranged["output"], arranged["form"]).alias("back")).collect()
    assert all(r.text == r.back for r in rows) and {r.form for r in rows if not re.search("<[PSM]>", r.text)} == {"spm", "psm"}
