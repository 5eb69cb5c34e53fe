import random

from pyspark.sql import functions as F

from bahikhata.functions import recognised
from bahikhata.operators import filters, narrations
from bahikhata.operators.narration_words import BANK_TERMS


def column(spark, rows, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_cleaned_narrations(spark):
    rows = ["UPI/DR/2394823/AMAZON SELLER PAYMEN", "NEFT CR-HDFC0001234-MEHTA AND SONS", "", None, "ATM WDL 123456", "UPI209584004029coffee", "https://x.y/z user@okaxis IMPS/P2A/RAVI KUMAR", "123456789012"]
    got = column(spark, rows, narrations.cleaned)
    assert [r.cleaned for r in got[:1]] == ["UPI - Amazon Seller"] and got[0].confidence == 0.99
    assert got[2].cleaned == got[3].cleaned == "" and got[2].confidence == 0.0 and got[3].txn_type == "OTHER"
    assert got[4].cleaned == "Unknown" and got[5].cleaned == "UPI - Coffee"
    assert got[6].party == "RAVI Kumar" and got[7].cleaned == "Unknown" and got[7].payment_ref == "123456789012"


def test_title_case(spark):
    assert column(spark, ["HDFC bank of india", "the END of the day", "  two  words ", "É MIX"], narrations.title_case) == ["HDFC Bank of India", "The END of the Day", "Two Words", "É MIX"]


def test_ledger_names(spark):
    rows = ["ABC Traders- Mumbai", "A.B.C. Traders", "ABC Traders - Pune Branch", "Gaurav Vidwans", "VIDWANS GAURAV", "AMAZON PAY INDIA PVT LTD", "Foo Services Private Limited", "Ravi Kumar Ravi Stores", "Wi-Fi House Co", "", None]
    assert column(spark, rows, narrations.ledger_name) == ["ABC Traders", "ABC Traders", "ABC Traders", "Vidwans Gaurav", "Vidwans Gaurav", "Amazon", "FOO", "RAVI Kumar", "Wi-fi House CO", "", None]


def part_of(short, long):
    left = long.split()
    if not short.split() or len(short.split()) >= len(left):
        return False
    for w in short.split():
        at = next((x for x in left if x.startswith(w)), None)
        if len(w) < 4 or at is None:
            return False
        left.remove(at)
    return True


def test_parties_against_a_loop(spark):
    names = ["Gaurav Vidwans", "VIDWANS GAURAV", "Vidwans", "VIDWANSGAURAV MORESHW", "Mehta Traders", "MEHT", "Sharma And Sons Traders", "SHAR", "SHARMA SONS"]
    rows = [(i, names[i % len(names)] if i % 4 else names[3], "Rent" if i % 3 else "Mehta Traders", False) for i in range(60)]
    df = spark.createDataFrame(rows, "ord int, vendor string, account_head string, x boolean")
    spelled = dict(zip(names + ["Mehta Traders"], column(spark, names + ["Mehta Traders"], narrations.ledger_name)))
    weight = {}
    for _, v, h, _ in rows:
        for x in [v] + [h] * (h != "Rent"):
            key = tuple(sorted(spelled[x].upper().split()))
            weight[key] = weight.get(key, 0) + 1
    name_of = {}
    for x in spelled.values():
        key = tuple(sorted(x.upper().split()))
        name_of[key] = min(x, name_of.get(key, x))

    def want(raw):
        key = tuple(sorted(spelled[raw].upper().split()))
        longer = [(-weight[k], n) for k, n in name_of.items() if k != key and part_of(name_of[key].upper(), n.upper())]
        return min(longer)[1] if longer else name_of[key]
    got = narrations.with_canonical(df).orderBy("ord").collect()
    assert len(got) == len(rows)
    for (_, v, h, _), r in zip(rows, got):
        assert r.vendor == want(v) and r.renamed == (r.vendor != v) and r.account_head == ("Rent" if h == "Rent" else want(h))


def test_recognised_text(spark):
    rows = ["O1/O2/2O24 PAYMFNT 1,2OO.5O", "  ", "BALANSE b/f", "NEFT cash zl0"]
    assert column(spark, rows, recognised.corrected) == ["01/02/2024 PAYMENT 1,200.50", "  ", "BALANCE b/f", "NEFT cash zl0"]


def test_filters_let_unknown_names_through(spark):
    df = spark.createDataFrame([("Import batch of rules", True), ("edited", None)], "e string, is_opening_balance boolean")
    assert df.where(filters.audit_filter(F.col("e"), "none", "")).count() == 2 and df.where(filters.audit_filter(F.col("e"), "import", "rule")).count() == 1
    assert filters.real_rows(df).count() == 1


def test_bank_term_is_the_nearest(spark):
    """Terms that parts rule out are none of the nearest: random edits of terms against all distances."""
    rng = random.Random(4)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def edited(word):
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(word) + 1)
            word = word[:at] + rng.choice(["", "E", "Q", "A"]) + word[at + rng.randrange(2):]
        return word
    words = sorted({edited(rng.choice(BANK_TERMS)) for _ in range(1500)} - {""})
    want = {}
    for w in words:
        most = 1 if len(w) <= 5 else 2 if len(w) <= 8 else 3
        near = [(d, i) for i, t in enumerate(BANK_TERMS) if (d := distance(w, t)) <= most]
        want[w] = BANK_TERMS[min(near)[1]] if near and 4 <= len(w) <= 15 else None
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", recognised.bank_term(F.col("w")).alias("term"))
    assert dict(map(tuple, rows.collect())) == want and len(set(want.values())) > 30
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein") <= 2  # once each term's distance to each word was worked out


def test_repaired_digits(spark):
    texts = ["O1S/ABC", "12345", "A", "OIL lO,Z|", "O1x O1", "", "\tO\n", "B" * 21]
    want = ["015/ABC", "12345", "4", "OIL 10,2|", "O1x 01", "", "\t0\n", "B" * 21]
    rows = spark.createDataFrame([(t, w) for t, w in zip(texts, want)], "t string, w string").select(recognised.repaired_digits(F.col("t")).alias("t"), "w")
    assert all(r.t == r.w for r in rows.collect())
