"""DuckDB SQL for the registered queries, over the same tables.

The logic is written apart from the DataFrame code that it checks; tables of words and patterns (the imports below) are shared with it, so a word that is missing is missing on both
sides. The unit tests hold such tables against answers written by hand.
"""

from __future__ import annotations

from bahikhata.functions.text import GLUED_REFERENCE, HEADERS, PAYMENT_TYPES, REFERENCES, TOTALS
from bahikhata.operators.bank_words import IFSC_BANKS, PHRASE_WEIGHTS, PHRASES, SHORT_NAMES
from bahikhata.operators.narration_words import BANK_TERMS, BANK_TOKENS, JUNK, PREFIXES, SMALL_WORDS, VENDORS
from bahikhata.operators.ledger_words import GST_RATES, GST_VENDORS, LADDER, RAILS, keyword_rows
from bahikhata.sources.driver_tables import BANKS, NARRATIONS


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def any_of(column: str, words: list[str] | tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


TXN = f"""WITH e AS (SELECT *, lpad(CAST(event_id AS VARCHAR), 12, '0') AS ref12, event_type IN ('purchase', 'click', 'error') AS is_out, CAST(value AS DECIMAL(18,2)) AS amount FROM events),
t0 AS (SELECT user_id % 5 + 1 AS client_id, event_id AS ord, 't_' || event_id AS id, user_id AS account, CAST(ts AS DATE) AS date, strftime(ts, '%d/%m/%Y') AS date_raw,
 replace([{', '.join(map(text, NARRATIONS))}][event_id % {len(NARRATIONS)} + 1], '{{r}}', ref12) AS narration, CASE WHEN event_id % 4 = 0 THEN ref12 ELSE '' END AS reference,
 CASE WHEN is_out THEN amount END AS debit, CASE WHEN NOT is_out THEN amount END AS credit, [{', '.join(map(text, BANKS))}][user_id % 4 + 1] AS bank_name, '5010' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS account_no,
 CASE WHEN event_id % 7 = 3 THEN 'Suspense' WHEN event_id % 11 = 5 THEN 'Manual' WHEN event_id % 13 = 1 THEN 'NeedsReview' ELSE 'Unreviewed' END AS status FROM e),
txn AS (SELECT *, CASE WHEN ord % 3 <> 1 THEN CAST(sum(coalesce(credit, 0) - coalesce(debit, 0)) OVER (PARTITION BY account ORDER BY ord) + 1000 + CASE WHEN ord % 41 = 0 THEN 500 ELSE 0 END AS DECIMAL(18,2)) END AS balance FROM t0)"""

UP = "upper(CASE WHEN reference = '' THEN narration ELSE narration || ' ' || reference END)"


def ladder(what: str) -> str:
    """CASE for one field of the keyword ladder; rails are left to the caller."""
    out = []
    for head, kind, vendor, words, vendors in LADDER:
        name = text("Bank A/c" if vendor == "*bank" else vendor)
        for word, special in reversed(vendors):
            name = f"CASE WHEN contains(up, {text(word)}) THEN {text(special)} ELSE {name} END"
        value = {"head": text(head), "txn_type": text(kind), "vendor": name}[what]
        out.append(f"WHEN {any_of('up', words)} THEN {value}")
    return "CASE " + " ".join(out) + " END"


KEYWORDS = f"{TXN}, k0 AS (SELECT *, {UP} AS up FROM txn), kw AS (SELECT *, {ladder('head')} AS kw_head, {ladder('txn_type')} AS kw_type, {ladder('vendor')} AS kw_vendor, {any_of('up', RAILS)} AS on_rail FROM k0)"

HASH = """format('{:x}', list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(concat_ws('|', date_raw, narration, coalesce(rtrim(rtrim(CAST(debit AS VARCHAR), '0'), '.'), 'null'), coalesce(rtrim(rtrim(CAST(credit AS VARCHAR), '0'), '.'), 'null')), ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296))"""

REASONS = """array_to_string(list_filter([CASE WHEN length(date_raw) < 8 THEN 'Missing or invalid date' END, CASE WHEN coalesce(debit, credit) IS NULL THEN 'No amount (debit or credit)' END, CASE WHEN abs(coalesce(debit, credit)) > 2000000000 THEN 'Amount exceeds ₹200 crore' END,
 CASE WHEN coalesce(debit, credit) < 0 THEN 'Negative amount — check column detection' END, CASE WHEN strlen(trim(narration)) < 2 THEN 'Empty or very short narration' END, CASE WHEN balance < -1000000 THEN 'Suspiciously negative balance' END], lambda x: x IS NOT NULL), '; ')"""
REVIEW = f"CASE WHEN status = 'NeedsReview' THEN true WHEN status IN ('Suspense', 'Manual') THEN false ELSE {REASONS} <> '' END"

_PAYMENT = "CASE " + " ".join(f"WHEN {any_of('upper(narration)', words)} THEN {text(name)}" for name, words in PAYMENT_TYPES) + " ELSE 'OTHER' END"
_REF = "coalesce(" + ", ".join(f"nullif(regexp_extract(narration, {text(p)}, 1), '')" for p in REFERENCES) + ", '')"
_NOISE = f"(trim(lower(narration)) <> '' AND (regexp_matches(trim(lower(narration)), {text('|'.join(TOTALS))}) OR regexp_matches(trim(lower(narration)), {text('|'.join(HEADERS))})))"

_GST_GROUP = {i: "CASE " + " ".join(f"WHEN {any_of('upper(txt)', words)} THEN {v}" for rate, kind, ledger, words in GST_VENDORS for v in [(f"CAST({rate} AS DOUBLE)", text(kind), text(ledger))[i]]) + " END" for i in range(3)}
_GST_SAID = "CASE " + " ".join(f"WHEN regexp_matches(lower(txt), '\\b{r}\\s*%?\\s*(gst|tax)\\b|gst\\s*@?\\s*{r}\\b') THEN CAST({r} AS DOUBLE)" for r in GST_RATES) + " END"
GST = f"""{TXN}, g0 AS (SELECT *, narration || ' ' || reference || ' ' AS txt FROM txn), g1 AS (SELECT *, {_GST_SAID} AS said, {_GST_GROUP[0]} AS v_rate, {_GST_GROUP[1]} AS v_type, {_GST_GROUP[2]} AS v_ledger,
 CASE WHEN regexp_matches(lower(txt), '\\bigst\\b') THEN 'IGST' WHEN regexp_matches(lower(txt), '\\bcgst\\b|\\bsgst\\b|\\butgst\\b') THEN 'CGST+SGST' END AS component, regexp_matches(lower(txt), '\\bgst\\b|\\bigst\\b|\\bcgst\\b|\\bsgst\\b') AS mention,
 list_distinct(regexp_extract_all(txt, '[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][1-9A-Z]Z[0-9A-Z]')) AS gstins FROM g0),
g2 AS (SELECT *, coalesce(said, v_rate) AS rate, coalesce(component, v_type, CASE WHEN coalesce(said, v_rate) IS NOT NULL THEN 'CGST+SGST' END) AS kind, CASE WHEN debit IS NOT NULL THEN 'Input' ELSE 'Output' END AS side FROM g1 WHERE mention OR v_rate IS NOT NULL OR len(gstins) > 0 OR said IS NOT NULL)
SELECT ord, rate AS gst_rate, kind AS gst_type, CASE WHEN rate > 0 THEN round(CAST(coalesce(debit, credit) AS DOUBLE) * rate / (100 + rate), 2) END AS gst_amount, CAST(len(gstins) AS BIGINT) AS n_gstins, v_ledger AS expense_ledger,
 CASE WHEN kind = 'EXEMPT' OR rate = 0 THEN NULL WHEN kind = 'IGST' THEN 'IGST ' || side || ' (' || rtrim(rtrim(CAST(CAST(rate AS DECIMAL(18,2)) AS VARCHAR), '0'), '.') || '%)'
  WHEN kind IS NOT NULL AND rate IS NOT NULL THEN 'CGST ' || side || ' (' || rtrim(rtrim(CAST(CAST(rate / 2 AS DECIMAL(18,2)) AS VARCHAR), '0'), '.') || '%) + SGST ' || side || ' (' || rtrim(rtrim(CAST(CAST(rate / 2 AS DECIMAL(18,2)) AS VARCHAR), '0'), '.') || '%)' END AS suggested_ledger,
 CAST(least((CASE WHEN len(gstins) > 0 THEN 35 ELSE 0 END) + (CASE WHEN component IS NOT NULL THEN 20 ELSE 0 END) + (CASE WHEN said IS NOT NULL THEN 20 ELSE 0 END) + (CASE WHEN v_rate IS NOT NULL THEN 15 ELSE 0 END) + (CASE WHEN mention THEN 10 ELSE 0 END), 99) AS DOUBLE) / 100 AS confidence FROM g2"""

#: Classified by keywords alone, with the group of the head.
_WORDS = ", ".join(f"({text(w)}, {n}, {text(g)}, {o})" for w, n, g, o in keyword_rows())
HEADED = f"""{KEYWORDS}, c AS (SELECT *, coalesce(kw_head, CASE WHEN on_rail THEN CASE WHEN credit IS NOT NULL THEN 'Sundry Debtors' ELSE 'Sundry Creditors' END END, '') AS account_head, coalesce(kw_vendor, '') AS vendor, coalesce(kw_type, CASE WHEN credit IS NOT NULL THEN 'Receipt' ELSE 'Payment' END) AS txn_type FROM kw),
w(word, weight, grp, first) AS (VALUES {_WORDS}), s AS (SELECT account_head, grp, first, sum(weight) AS score FROM (SELECT DISTINCT account_head FROM c) h JOIN w ON contains(lower(trim(account_head)), word) GROUP BY ALL),
b AS (SELECT account_head, arg_max(grp, struct_pack(s := score, f := -first)) AS grp FROM s GROUP BY 1),
h AS (SELECT c.*, coalesce(b.grp, CASE WHEN coalesce(debit, credit) >= 10000 THEN CASE WHEN credit IS NULL THEN 'Sundry Creditors' ELSE 'Sundry Debtors' END WHEN credit IS NOT NULL THEN 'Indirect Income' ELSE 'Indirect Expenses' END) AS ledger_group FROM c LEFT JOIN b USING (account_head))"""
POSTING = "coalesce(nullif(account_head, ''), nullif(vendor, ''), 'Unclassified')"

PREV = f"""{TXN}, p0 AS (SELECT *, coalesce(credit, 0) - coalesce(debit, 0) AS net, count(balance) OVER w AS anchor, last_value(balance IGNORE NULLS) OVER w AS stated FROM txn WINDOW w AS (PARTITION BY account ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT account, arg_min(balance - net, ord) FILTER (balance IS NOT NULL) AS opening FROM p0 GROUP BY 1),
p AS (SELECT p0.*, opening, CAST(coalesce(stated, opening) + coalesce(sum(CASE WHEN balance IS NULL THEN net END) OVER (PARTITION BY account, anchor ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(18,2)) AS prev_balance FROM p0 JOIN o USING (account))"""

ACCOUNTS = f"""{PREV}, a AS (SELECT account, CAST(arg_min(prev_balance, ord) AS DOUBLE) AS opening, CAST(arg_max(balance, ord) FILTER (balance IS NOT NULL) AS DOUBLE) AS closing, count(*) AS n, CAST(coalesce(sum(credit), 0) AS DOUBLE) AS credits, CAST(coalesce(sum(debit), 0) AS DOUBLE) AS debits FROM p GROUP BY 1)"""


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(text, words)) + ")"


_TELLS = f"strlen(w) > 1 AND NOT regexp_full_match(w, '[0-9]+') AND upper(w) NOT IN {_in(JUNK)}"
_TITLED = f"array_to_string(list_transform(list_filter(string_split({{0}}, ' '), lambda w: w <> ''), lambda w, i: CASE WHEN strlen(w) <= 4 AND regexp_full_match(w, '[A-Z]+') AND lower(w) NOT IN {_in(SMALL_WORDS)} THEN w WHEN lower(w) IN {_in(SMALL_WORDS)} AND i > 1 THEN lower(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ')"
_GLUE = "regexp_replace(regexp_replace(regexp_replace(array_to_string(parts, ' '), '[0-9]{6,22}', ' ', 'g'), '\\b[A-Z]{2,4}[0-9]{6,}\\b', ' ', 'g'), '\\b[A-Z]{4}0[A-Z0-9]{6}\\b', ' ', 'g')"
_POINTS = f"3 - (CASE WHEN upper(w) IN {_in(BANK_TOKENS)} THEN 3 ELSE 0 END) - (CASE WHEN regexp_matches(w, '^[0-9]') THEN 4 ELSE 0 END) + greatest(0, least(strlen(w) - 5, 3))"
CLEANED = f"""{TXN}, c0 AS (SELECT ord, trim(narration) AS t, {_PAYMENT} AS kind, {_REF} AS ref FROM txn),
c1 AS (SELECT *, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(t, 'https?://\\S+', ' ', 'g'), '\\S+@[a-z]+\\b', ' ', 'g'), '[/|\\\\]'), lambda w: trim(w)), lambda w: {_TELLS} AND NOT (regexp_matches(upper(w), '^[A-Z]{{4}}0') AND strlen(w) = 11)) AS parts FROM c0),
c2 AS (SELECT *, list_filter(regexp_split_to_array({_GLUE}, '\\s+'), lambda w: {_TELLS}) AS words FROM c1),
c3 AS (SELECT *, array_to_string(words, ' ') AS s, list_transform(words, lambda w: {_POINTS}) AS points FROM c2),
c4 AS (SELECT *, list_transform(range(1, len(words) + 1), lambda i: struct_pack(score := list_sum(points[i:i + 4]), first := -i, name := array_to_string(words[i:i + 4], ' '))) AS spans FROM c3),
c5 AS (SELECT *, coalesce(CASE {' '.join(f"WHEN contains(upper(s), {text(k)}) THEN {text(v)}" for k, v in VENDORS)} END, CASE WHEN len(words) > 0 AND list_max(spans).score > 0 THEN left(list_max(spans).name, 40) END, '') AS p FROM c4),
c6 AS (SELECT *, {_TITLED.format('p')} AS party, left({_TITLED.format('s')}, 40) AS rest, CASE kind {' '.join(f"WHEN {text(k)} THEN {text(v)}" for k, v in PREFIXES)} ELSE '' END AS pre FROM c5),
c7 AS (SELECT *, CASE WHEN party = '' AND rest = '' THEN 'Unknown' WHEN kind IN ('ATM', 'CASH', 'INTEREST', 'CHARGES') THEN CASE WHEN party = '' THEN pre ELSE pre || ' - ' || party END ELSE pre || CASE WHEN party = '' THEN rest ELSE party END END AS whole FROM c6)
SELECT ord, trim(whole) AS cleaned, kind AS txn_type, party, ref AS payment_ref, least(99, 40 + (CASE WHEN kind <> 'OTHER' THEN 15 ELSE 0 END) + (CASE WHEN strlen(party) >= 3 THEN 15 ELSE 0 END) + (CASE WHEN strlen(party) >= 6 THEN 10 ELSE 0 END) + (CASE WHEN {' OR '.join(f"starts_with(upper(party), {text(k)})" for k, _ in VENDORS)} THEN 15 ELSE 0 END) + (CASE WHEN strlen(whole) / strlen(t) < 0.8 THEN 5 ELSE 0 END)) / 100 AS confidence, true AS shown FROM c7"""

_SIGNS = "[\\s/\\-.,|:]"
_DIGITS = f"array_to_string(list_transform(regexp_extract_all({{0}}, '{_SIGNS}+|[^\\s/\\-.,|:]+'), lambda t: CASE WHEN regexp_full_match(t, '[0-9OoIlSZBGqQAg]{{{{1,20}}}}') THEN translate(t, 'OoIlSZzBGqQAg', '0011522869949') ELSE t END), '')"
_TERMS = "[" + ", ".join(map(text, BANK_TERMS)) + "]"
_TERM = f"""CASE WHEN regexp_full_match(w, '[A-Za-z]{{{{4,}}}}') AND length(w) <= 15 AND NOT list_contains({_TERMS}, upper(w)) THEN coalesce(list_min(list_filter(list_transform({_TERMS}, lambda t, i: struct_pack(d := levenshtein(upper(w), t), i := i, t := t)), lambda x: x.d <= CASE WHEN length(w) <= 5 THEN 1 WHEN length(w) <= 8 THEN 2 ELSE 3 END)).t, w) ELSE w END"""
_LINE = "array_to_string(list_transform(list_filter(regexp_split_to_array(" + _DIGITS + ", '\\s+'), lambda w: w <> ''), lambda w: " + _TERM + "), ' ')"
RECOGNISED = f"""{TXN}, r0 AS (SELECT ord, CASE WHEN ord % 2 = 0 THEN translate(narration, '015', 'OIS') ELSE replace(replace(narration, 'PAYMENT', 'PAYMFNT'), 'CHARGES', 'CHRGFS') END AS l0 FROM txn), r1 AS (SELECT ord, {_LINE.format('l0')} AS l1 FROM r0) SELECT ord, {_LINE.format('l1')} AS line FROM r1"""

_ROWS_OF = ", ".join
_PHRASE_ROWS = _ROWS_OF(f"({text(p)}, {text(bank)}, {PHRASE_WEIGHTS.get(bank, 1.0)})" for bank, phrases in PHRASES for p in phrases)
_PHRASE = "(" + "|".join(p.replace(".", "\\.") for _, phrases in PHRASES for p in phrases) + ")"
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9.@]+', ' ', 'g'))"
_SHORT = "[" + _ROWS_OF(f"struct_pack(s := {text(s)}, bank := {text(bank)})" for s, bank in SHORT_NAMES) + "]"
_NEAR = "list_filter(list_transform(list_filter(regexp_split_to_array(upper({0}), '[ /\\\\\\-|,._@]'), lambda w: strlen(w) BETWEEN 3 AND 8), lambda w: list_transform(list_filter(" + _SHORT + ", lambda n: levenshtein(w, n.s) <= 1), lambda n: struct_pack(bank := n.bank, exact := n.s = w))[1]), lambda h: h IS NOT NULL)[1]"
#: Statements made of customers: each kind of evidence, one of nine.
STATEMENTS = """SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'HDFC BANK LTD MG ROAD IFSC Code: HDFC0' || code || ' A/c No: 5010' || code WHEN 1 THEN 'Statement' WHEN 2 THEN 'STATEMENT OF Kotak-Mahindra BANK for ' || c_name WHEN 3 THEN 'AX1S STATEMENT'
 WHEN 7 THEN 'Central Bank of India, Bank of India Building' ELSE 'Statement for ' || c_name END AS header_text,
 CASE c_custkey % 9 WHEN 1 THEN 'visit www.icicibank.com' WHEN 4 THEN 'NEFT/HDFCBANK/998877 paid. Federal Bank, Main road' ELSE '' END AS body, CASE WHEN c_custkey % 9 = 5 THEN 'Canara_Bank_' || code || '.pdf' ELSE 'x.pdf' END AS filename,
 CASE WHEN c_custkey % 9 = 6 THEN ['NEFT YESB0' || code, 'IMPS SBIN0' || code, 'to yesb0' || code] ELSE ['TEA'] END AS narrations FROM (SELECT *, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code FROM customer)"""
BANKED = f"""WITH phr(phrase, bank, weight) AS (VALUES {_PHRASE_ROWS}), codes(code, bank) AS (VALUES {_ROWS_OF(f"({text(k)}, {text(v)})" for k, v in IFSC_BANKS.items())}),
s AS (SELECT *, header_text || ' ' || body AS txt FROM ({STATEMENTS})),
m AS (SELECT *, upper(regexp_extract(header_text, '(?i)ifsc(?:\\s*code)?\\s*[:\\-]?\\s*([A-Z]{{4}})0[A-Z0-9]{{6}}', 1)) AS lab, upper(regexp_extract(header_text, '(?i)\\b([A-Z]{{4}})0[A-Z0-9]{{6}}\\b')) AS full_code,
 regexp_extract({_NORM.format('header_text')}, '\\b{_PHRASE}\\b', 1) AS p_head, regexp_extract({_NORM.format("regexp_replace(txt, '(?i)\\b(?:UPI|NEFT|IMPS|RTGS|ECS|NACH|ACH|POS)[A-Z]{0,3}[:\\-]?/?[A-Za-z0-9@/.\\-]{6,100}', ' ', 'g')")}, '\\b{_PHRASE}\\b', 1) AS p_text,
 regexp_extract({_NORM.format('filename')}, '\\b{_PHRASE}\\b', 1) AS p_name, {_NEAR.format('header_text')} AS near_head, {_NEAR.format('filename')} AS near_name FROM s),
e AS (SELECT c_custkey, 1 AS tier, 2.0 AS gate, bank, 0.98 AS conf, 'ifsc_labeled' AS how FROM m JOIN codes ON lab = code
 UNION ALL SELECT c_custkey, 2, 0.95, 'ICICI Bank', 0.95, 'domain' FROM m WHERE contains(lower(txt), 'icicibank.com')
 UNION ALL SELECT c_custkey, 3, 0.95, bank, 0.95 * weight, 'phrase' FROM m JOIN phr ON p_head = phrase
 UNION ALL SELECT c_custkey, 4, 0.75, near_head.bank, CASE WHEN near_head.exact THEN 0.85 ELSE 0.72 END, CASE WHEN near_head.exact THEN 'abbrev_exact' ELSE 'abbrev_fuzzy' END FROM m WHERE near_head IS NOT NULL
 UNION ALL SELECT c_custkey, 5, 0.82, bank, least(0.95 * weight, 0.8), 'phrase_full' FROM m JOIN phr ON p_text = phrase
 UNION ALL SELECT c_custkey, 6, 0.70, coalesce(bank, near_name.bank), 0.65, 'filename' FROM m LEFT JOIN phr ON p_name = phrase WHERE coalesce(bank, near_name.bank) IS NOT NULL
 UNION ALL SELECT c_custkey, 7, 0.60, bank, 0.55, 'narration_ifsc' FROM (SELECT c_custkey, upper(regexp_extract(n, '(?i)\\b([A-Z]{{4}})0[A-Z0-9]{{6}}\\b', 1)) AS c4, count(*) AS k FROM (SELECT c_custkey, unnest(narrations) AS n FROM m) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY c4 = '', k DESC, c4) = 1) JOIN codes ON c4 = code WHERE k >= 2),
-- The surest find below its gate: no lower tier can pass a gate that a surer one before it has closed.
w AS (SELECT * FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.c_custkey = a.c_custkey AND b.tier < a.tier AND (b.conf >= a.gate OR b.conf >= a.conf)) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY conf DESC, tier) = 1)
SELECT m.c_custkey, coalesce(bank, '') AS bank_name, CAST(coalesce(conf, 0) AS DOUBLE) AS confidence, coalesce(how, 'none') AS method, bank IS NOT NULL AND conf < 0.6 AS needs_review, CASE WHEN m.c_custkey % 9 = 0 THEN '5010XX' || right(full_code, 4) ELSE '' END AS account_no, full_code AS ifsc FROM m LEFT JOIN w USING (c_custkey)"""

SIDED = f"""{TXN}, l AS (SELECT CAST(account AS VARCHAR) AS file, CASE WHEN account % 2 = 1 THEN 100000000 - ord ELSE ord END AS row_idx, ord, date, coalesce(debit, credit) AS amt, ord % 3 = 0 AS two, ord % 5 = 0 AND debit IS NOT NULL AS dr, ord % 5 = 0 AND credit IS NOT NULL AS cr, coalesce(balance, 0) AS bal FROM txn),
d AS (SELECT file, arg_min(date, row_idx) > arg_max(date, row_idx) AS back FROM l GROUP BY 1),
v AS (SELECT l.*, bal - lag(bal) OVER (PARTITION BY file ORDER BY CASE WHEN back THEN -row_idx ELSE row_idx END) AS mv FROM l JOIN d USING (file)),
b AS (SELECT *, abs(abs(mv) - amt) AS g1, abs(abs(mv) - 56161) AS g2 FROM v),
c AS (SELECT *, CASE WHEN g1 <= g2 THEN amt ELSE 56161 END AS near, least(g1, g2) AS gap FROM b),
r AS (SELECT *, CASE WHEN NOT two THEN amt WHEN mv IS NULL THEN amt WHEN mv = 0 THEN NULL WHEN gap < greatest(near, 1) * 0.02 THEN near WHEN mv < 0 THEN amt ELSE 56161 END AS chosen,
 coalesce(CASE WHEN two THEN mv < 0 WHEN dr THEN true WHEN cr THEN false WHEN abs(mv - amt) < amt * 0.02 THEN false ELSE abs(mv + amt) < amt * 0.02 END, false) AS down FROM c)
SELECT file, ord, CAST(CASE WHEN down AND chosen > 0 THEN chosen END AS DECIMAL(18,2)) AS debit, CAST(CASE WHEN NOT down AND chosen > 0 THEN chosen END AS DECIMAL(18,2)) AS credit FROM r"""

#: Orders as files without a header: date, text, two amount columns and one more, ten years on; every third file has its balance first.
CONTENT = """WITH o AS (SELECT o_custkey % 20 AS f, o_orderkey, strftime(o_orderdate + INTERVAL 10 YEAR, '%d/%m/%Y') AS d, 'Order ' || o_orderpriority AS n, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p, o_orderstatus AS st FROM orders),
c AS (SELECT f, o_orderkey, unnest(CASE WHEN f % 3 = 0 THEN [p, d, n, CASE WHEN st = 'F' THEN p ELSE '' END, CASE WHEN st <> 'F' THEN p ELSE '' END] ELSE [d, n, CASE WHEN st = 'F' THEN p ELSE '' END, CASE WHEN st <> 'F' THEN p ELSE '' END, p] END) AS v, unnest([0, 1, 2, 3, 4]) AS pos FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY f ORDER BY o_orderkey) <= 15)),
s AS (SELECT f, pos, count(*) AS total, count_if(regexp_full_match(v, '[0-9]{2}/[0-9]{2}/[0-9]{4}')) AS dates, count_if(regexp_full_match(v, '[0-9]+\\.[0-9]{2}') AND v <> '0.00') AS amounts, avg(strlen(v)) AS width FROM c WHERE v <> '' GROUP BY ALL),
k AS (SELECT f FROM c GROUP BY f HAVING count(DISTINCT o_orderkey) >= 3),
d AS (SELECT f, max_by(pos, dates * 10 + pos) AS date FROM s JOIN k USING (f) WHERE dates * 2 > total GROUP BY f),
b AS (SELECT f, max_by(pos, amounts * 10 + pos) AS balance FROM s JOIN d USING (f) WHERE amounts * 10 > total * 7 AND pos <> date GROUP BY f),
a AS (SELECT f, list(pos ORDER BY pos) AS free FROM s JOIN d USING (f) LEFT JOIN b USING (f) WHERE amounts * 10 > total * 3 AND pos <> date AND pos <> coalesce(balance, -1) GROUP BY f),
t AS (SELECT f, max_by(pos, width * 10 + pos) AS narration FROM s JOIN d USING (f) WHERE (total - dates - amounts) * 10 > total * 3 GROUP BY f)
SELECT CAST(f AS VARCHAR) AS file, date, coalesce(balance, -1) AS balance, coalesce(free[1], -1) AS debit, coalesce(free[2], -1) AS credit, coalesce(narration, -1) AS narration FROM d LEFT JOIN b USING (f) LEFT JOIN a USING (f) LEFT JOIN t USING (f) WHERE len(free) > 0"""


def xml(x: str) -> str:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = f"replace({x}, {text(sign)}, {text(name)})"
    return x


def voucher(narration: str) -> str:
    """A voucher of a row with voucher, post, date, debit and credit."""
    amount = "printf('%.2f', CAST(coalesce(debit, credit, 0) AS DOUBLE))"
    return f"""format('<VOUCHER VCHTYPE="{{}}" ACTION="Create"><DATE>{{}}</DATE><NARRATION>{{}}</NARRATION><VOUCHERTYPENAME>{{}}</VOUCHERTYPENAME><ALLLEDGERENTRIES.LIST><LEDGERNAME>{{}}</LEDGERNAME><ISDEEMEDPOSITIVE>Yes</ISDEEMEDPOSITIVE><AMOUNT>-{{}}</AMOUNT></ALLLEDGERENTRIES.LIST><ALLLEDGERENTRIES.LIST><LEDGERNAME>{{}}</LEDGERNAME><ISDEEMEDPOSITIVE>No</ISDEEMEDPOSITIVE><AMOUNT>{{}}</AMOUNT></ALLLEDGERENTRIES.LIST></VOUCHER>',
 voucher, strftime(date, '%Y%m%d'), {xml(narration)}, voucher, {xml("CASE WHEN voucher IN ('Receipt', 'Contra') THEN 'Bank A/c' ELSE post END")}, {amount}, {xml("CASE voucher WHEN 'Receipt' THEN post WHEN 'Contra' THEN 'Cash' ELSE 'Bank A/c' END")}, {amount})"""
