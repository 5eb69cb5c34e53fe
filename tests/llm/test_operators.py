import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from bahikhata.llm import classifier, html, licenses, media, mixing, outliers, sharding, simhash
from bahikhata.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(d):
    return -1 if d is None else d


# SimHash

def brute_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{index: smallest id}; links at 4 bits or fewer."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j][1]).count("1") <= 4:
                parent[find(i)] = find(j)
    out = []
    for i in range(len(prints)):
        ids = [d for k, (d, _) in enumerate(prints) if find(k) == find(i) and d is not None]
        out.append(min(ids, default=None))
    return out


def test_simhash_against_brute_force(spark, small):
    docs = table(spark, small, "documents")
    rows = docs.collect()
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in rows]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(prints, brute_components(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digest(docs).collect()} == want


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def roots_by_hand(prints):
    """{fp: smallest reachable}, all pairs held against each other with numpy."""
    bits = np.array([x & (1 << 64) - 1 for x in prints], np.uint64)
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(bits[i + 1:] ^ bits[i]) <= 4).tolist():
            parent[find(i + 1 + j)] = find(i)
    least = {}
    for i, x in enumerate(prints):
        least[find(i)] = min(least.get(find(i), x), x)
    return {x: least[find(i)] for i, x in enumerate(prints)}


def test_simhash_links_miss_none(spark):
    """Stars, chains, and groups that crowd each other's keys, against all pairs."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (1, 2, 3, 4, 5, 6)]
    crowd = [int(base[0]) ^ sum(1 << int(k) for k in rng.choice(26, n, replace=False)) for n in (3, 4, 5, 6, 7, 8, 9) for _ in range(60)]
    chain = [int(base[1])]
    for _ in range(80):
        chain.append(chain[-1] ^ sum(1 << int(k) for k in rng.choice(64, 4, replace=False)))
    prints = sorted({signed(x) for x in {int(x) for x in base} | set(near) | set(crowd) | set(chain)})
    want = {x: r for x, r in roots_by_hand(prints).items() if x != r}
    assert {r.node: r.root for r in simhash.linked_roots(spark.createDataFrame([(x,) for x in prints], "fp long")).collect()} == want


def test_simhash_near_copies_make_linear_links(spark):
    rng = np.random.default_rng(8)
    centre, prints = 0x0123456789ABCDEF, set()
    while len(prints) < 2000:
        prints.add(signed(centre ^ sum(1 << int(k) for k in rng.choice(64, 2, replace=False))))
    classes = spark.createDataFrame([(x,) for x in prints], "fp long")
    links = simhash.to_least(simhash.matched(classes)).count()
    assert links < 75 * len(prints)
    roots = simhash.linked_roots(classes).collect()
    assert len(roots) == len(prints) - 1 and {r.root for r in roots} == {min(prints)}


def test_simhash_odd_rows(odd, none):
    rows = simhash.digest(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert {(r.fingerprint, r.component_id) for r in rows if r.doc_id in (3, 4, 5)} == {("0" * 16, 3)}
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(key(r.doc_id) for r in kept.collect()) == [-1, 1, 3, 6, 7]
    assert simhash.digest(none).count() == 0


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(pairs).collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_exploded_keys_are_not_broadcast(spark):
    """A fingerprint looks at 69 keys, which Spark's estimate of the table doesn't see: broadcast, the driver would hold them all."""
    classes = spark.range(40).select(F.col("id").alias("fp"))
    index, probe = simhash._keys(classes)
    assert probe.count() == 40 * 69
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    met = simhash.matched(classes)
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [done.apply(i).physicalPlanDescription() for i in range(before, done.size())]
    assert met.count() > 0 and any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)


def test_components_run_few_jobs(spark):
    """The driver's memory grows with plans and their threads: each step is planned once, and stars need no round."""
    def jobs(group, pairs):
        spark.sparkContext.setJobGroup(group, group)
        simhash.components(spark.createDataFrame(pairs, "a long, b long"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    assert jobs("stars", [(7, i) for i in range(8, 30)]) <= 6
    assert jobs("chain", [(i, i + 1) for i in range(4)]) <= 30


# Pages

PAGE = "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><a href=/x>Menu</a></nav>{}<footer>&copy; end</footer></body></html>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_article_of_each_page_is_whole(spark, small):
    import html as std

    rows = table(spark, small, "pages")
    got = {r.page_id: r.text for r in html.digest(rows).collect()}
    for r in rows.collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(std.unescape(re.sub("</?b>", "", re.sub("<(?!/?b>)[^>]*>", " ", inner))).split())


def test_shared_lines_of_neighbours_go(spark):
    block = "<div><p>Welcome to our site</p></div><div><p>{}</p><p>More&nbsp;words &amp; {} things</p></div><div>Call us now</div>"
    rows = [(i, f"http://h.example/news/{i}", PAGE.format(block.format(f"Story number {i} begins with many words", i))) for i in range(4)]
    rows += [(9, "http://other.example/a", PAGE.format("<p>Alone here</p>")), (10, None, None), (11, "not a url", "")]
    got = {r.page_id: (r.text, r.n_chars) for r in html.digest(pages(spark, rows).repartition(60)).collect()}
    for i in range(4):
        assert got[i][0] == f"Story number {i} begins with many words More words & {i} things"
    assert got[9] == ("Alone here", 10) and got[10] == ("", 0) and got[11] == ("", 0)


def test_heavy_template_goes_from_bare_pages(spark, monkeypatch):
    monkeypatch.setattr(html, "STRETCH", 2)
    block = "<p>" + "</p><p>".join(f"line {i} of the heavy template of this site" for i in range(9)) + "</p><p>Short {}</p>"
    rows = [(i, f"http://h.example/news/{i:02}", PAGE.format(block.format("text" if i in (3, 5, 6) else i))) for i in range(9)]
    rows += [(100 + i, f"http://h.example/news/{i:02}a", PAGE.format(f"<article>Whole {i}</article>")) for i in range(9)]
    got = {r.page_id: r.text for r in html.digest(pages(spark, rows).repartition(5)).collect()}
    assert got == {i: f"Short {'text' if i in (3, 5, 6) else i}" for i in range(9)} | {100 + i: f"Whole {i}" for i in range(9)}


def left(ours, first, second):
    gone = html.template(ours, [len(x.split()) for x in ours], first, second)
    return [x for i, x in enumerate(ours) if i not in gone]


def test_near_copy_is_not_a_template():
    text, menu = ["one two three four five six", "seven eight nine ten"], ["menu of the site"]
    assert left(menu + text + ["x"], menu + text + ["y"], menu + ["other words"]) == text + ["x"]
    assert left(menu + text, menu + text + ["y"], None) == menu + text


def brute_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_every_page_is_held_against_its_neighbour(spark, small):
    rows = table(spark, small, "pages")
    out = {r.page_id: r for r in html.digest(rows).collect()}
    found = {r.page_id: [t for t, _ in html.lines(r.html)] for r in rows.collect()}
    urls = {r.page_id: re.match(r"\w+://([^/]+)([^?#]*)", r.url).groups() for r in rows.collect()}
    hosts = Counter(h for h, _ in urls.values())
    for p, r in out.items():
        assert (r.partner is None) == (hosts[urls[p][0]] == 1)
        if r.partner is not None:
            assert urls[r.partner][0] == urls[p][0]
            common = html.shared(found[p], found[r.partner])
            assert len(common) == brute_common(found[p], found[r.partner])
    assert sum(r.partner is not None for r in out.values()) > 0.8 * len(out) and sum(r.n_template for r in out.values()) > 0


def test_shared_lines_outside_an_article_are_counted_and_those_inside_stay(spark):
    shell = "<body><p>Site name and motto</p><article><p>Quoted passage of both</p><p>Own text {}</p></article><p>Call us</p></body>"
    rows = [(i, f"http://h.example/a/{i}", shell.format(i)) for i in range(4)]
    rows += [(9 + i, f"http://h.example/a/{9 + i}", f"<p>Site name and motto</p><p>Bare page text {i} of</p><p>Call us</p>") for i in range(3)]
    got = {r.page_id: r for r in html.digest(pages(spark, rows)).collect()}
    assert all(got[i].text == f"Quoted passage of both Own text {i}" and got[i].n_template == 2 for i in range(4))
    assert all((got[9 + i].text, got[9 + i].n_template) == (f"Bare page text {i} of", 2) for i in range(3))


def test_unbalanced_quotes_in_tags():
    words = lambda page: [t for t, z in html.lines(page) if z != html.DROPPED]
    assert words("<p class=it's>Hello</p><p title='a > b' id=\"c>d\">World</p>") == ["Hello", "World"]
    assert words("<p title=\"open>one</p><p>two</p>") == ["one", "two"]
    assert words("<a href=x?a=1&b='2>link</a> 3 < 4 > 2 <p =>x</p>") == ["link 3 < 4 > 2", "x"]
    assert words("<div class='related-work'>A</div><article><section class='market-share'><p>Share rose</p></section></article>") == ["A", "Share rose"]
    assert words("<p " + "a='" * 20_000 + ">x") is not None


def test_copies_are_not_a_template(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format("<p>One two three four</p><p>Five six</p>")) for i in range(2)]
    assert {r.text for r in html.digest(pages(spark, rows)).collect()} == {"One two three four Five six"}


@pytest.mark.parametrize("part", ["<aside>x</aside>", "<form><label>x</label></form>", "<div class='cookie-notice'>x</div>", "<div id=sidebar>x</div>", "<section class=\"comments\"><p>x</p></section>", "<header><p>x</p></header>",
                                  "<!-- <p>x</p> -->", "<style>p{x}</style>", "<div hidden>x</div>", "<ul role=navigation><li>x</ul>", "<article class=comment>x</article>"])
def test_parts_that_are_no_text(part):
    kept = [t for t, z in html.lines(f"<body>{part}<article><h1>A</h1>{part if 'header' not in part else ''}<p>B<br>C <b>d</b>e</article>{part}") if z == html.MAIN]
    assert " ".join(kept) == "A B C de"


@pytest.mark.parametrize("wrapper", ["div id='page' class='site no-sidebar'", "div class='has-sidebar'", "div class=search-results", "section class='social-sciences'", "div class='sidebar'", "div class=widget", "div class=related-posts",
                                     "div data-hidden='false'", "div title='The hidden cost'", "div data-x='a class=ad b'", "div title='display:none'"])
@pytest.mark.parametrize("part", ["article", "main", "div itemprop=articleBody"])
def test_wrapped_articles_are_whole(wrapper, part):
    page = f"<body><{wrapper}><nav>x</nav><{part}><p>A</p><div class='ad'>x</div><p title='hidden role=menu'>B</p></{part.split()[0]}></{wrapper.split()[0]}></body>"
    assert [t for t, z in html.lines(page) if z == html.MAIN] == ["A", "B"]


def test_other_articles_stay_out():
    page = "<div class='site has-comments'><article>A</article><div class='related-posts'><article>x</article></div><div id=comments><article class=comment>x<article>x</article></article></div></div>"
    assert [t for t, z in html.lines(page) if z == html.MAIN] == ["A"]
    assert [t for t, z in html.lines("<div class='main-nav'>x</div><div class='site-footer' id=f>x</div><p>A</p>") if z == html.OPEN] == ["A"]


def test_common_subsequence():
    for a, b in (("abcbdab", "bdcaba"), ("", "a"), ("abc", "abc"), ("xaxbxc", "abc")):
        got = [a[i] for i in sorted(html.shared(list(a), list(b)))]
        rest = iter(b)
        assert len(got) == brute_common(a, b) and all(x in rest for x in got)


def test_no_pages(spark):
    assert html.digest(pages(spark, [])).count() == 0


# Quality rules

def brute_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_against_brute_force(spark, small, odd):
    for docs in (table(spark, small, "documents"), odd):
        texts = [(key(r.doc_id), r.text) for r in docs.collect()]
        got = sorted((key(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in outliers.digest(docs).collect())
        assert got == sorted((d, *(c := brute_counts(t)), c[0] < 10 or 100 * c[4] > 20 * c[0]) for d, t in texts)


def independent_mcd(x, starts=200):
    """(log determinant, mean, covariance) of the least regularised determinant of SHARE of the points, from many random starts."""
    rng, h, best = np.random.default_rng(0), -(-3 * len(x) // 4), None
    ridge = np.eye(4) * outliers.STEP ** 2
    for _ in range(starts):
        near, last = x[rng.choice(len(x), 6, replace=False)], np.inf
        while True:
            mean, cov = near.mean(0), np.cov(near.T, bias=True) + ridge
            now = np.linalg.slogdet(cov)[1]
            if len(near) == h:
                if now >= last - 1e-12:
                    break
                last = now
            off = x - mean
            near = x[np.argsort((off @ np.linalg.inv(cov) * off).sum(1), kind="stable")[:h]]
        best = min(best or (np.inf,), (now, mean, cov), key=lambda b: b[0])
    return best


def test_least_determinant_against_an_independent_search(spark):
    rng = np.random.default_rng(5)
    sets = {"one": np.concatenate([rng.normal(0, [3, 9, 4, 4], (300, 4)), rng.normal(60, 2, (40, 4))]),
            "two": np.concatenate([rng.normal(0, 5, (150, 4)) @ rng.normal(0, 1, (4, 4)), rng.normal([200, 0, 0, 0], 3, (30, 4)), rng.normal([0, 0, -90, 90], 3, (19, 4))]),
            "flat": np.round(rng.normal(0, [0, 6, 0, 0.4], (80, 4)))}
    rows = [(k, *map(int, v)) for k, x in sets.items() for v in np.round(x)]
    grid = spark.createDataFrame(rows, "group string, y0 long, y1 long, y2 long, y3 long").groupBy("group", *outliers.Y).count().withColumnRenamed("count", "n")
    grid = grid.withColumn("all", F.sum("n").over(Window.partitionBy("group")))
    got = {r.group: r for r in outliers.models(grid).collect()}
    for k, x in sets.items():
        x, r = np.round(x), got[k]
        det, mean, cov = independent_mcd(x)
        assert r.det <= det + 0.01
        low = np.array([[r[f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
        mine = np.array([r[f"m{i}"] for i in range(4)])
        distances = lambda m, c: (((x - m) @ np.linalg.inv(c)) * (x - m)).sum(1)
        far, want = distances(mine, low @ low.T), distances(mean, cov)
        assert np.corrcoef(np.argsort(np.argsort(far)), np.argsort(np.argsort(want)))[0, 1] > 0.97
        assert r.scale == pytest.approx(max(1, np.sort(far)[(len(x) - 1) // 2] / outliers.MEDIAN), rel=1e-9)


def test_planted_outliers_are_rejected(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, [0.2, 1, 0.1, 0.1], (300, 4)), rng.normal(3, 0.1, (40, 4))])
    rows = spark.createDataFrame([(None, "?", *map(float, v)) for v in x] + [("?", None, 9.0, 9.0, 9.0, 9.0)] * 60, "lang string, source string, x0 double, x1 double, x2 double, x3 double")
    grid, judge = outliers.grouped(outliers.cells(rows))
    model = {r.group: r for r in outliers.models(grid).collect()}
    by = {(r.lang, r.source): model[r.group] for r in judge.collect()}
    assert len(by) == len(set(map(id, by.values()))) == 2

    def far(m, v):
        low = np.array([[m[f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
        z = np.linalg.solve(low, v * outliers.STEP / np.array(outliers.FLOORS) - np.array([m[f"m{i}"] for i in range(4)]))
        return z @ z / m["scale"]
    d = np.array([far(by[None, "?"], v) for v in x])
    assert (d[300:] > outliers.CUTOFF).all() and (d[:300] < outliers.CUTOFF).all()
    assert far(by["?", None], np.full(4, 9.0)) < 1


def test_rules_keep_clean_documents(spark, small):
    labels = {r.doc_id: r.quality for r in table(spark, small, "labels").collect()}
    rows = [r for r in outliers.digest(table(spark, small, "documents")).collect() if r.doc_id in labels and not r.base_failed]
    assert all(r.kept for r in rows if labels[r.doc_id] == 1)
    assert np.mean([r.kept for r in rows if labels[r.doc_id] == 0]) < 0.3


def test_rare_sources_are_judged_by_their_language(spark):
    rng = np.random.default_rng(7)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(n))
    bad = " ".join(w + "#$%&|<>*" for w in words(60).split())
    rows = [(i, words(60), "en" if i % 2 else "de", "big") for i in range(800)]
    rows += [(1000, bad, "en", "rare"), (1001, words(60), "en", "rare2"), (1002, bad, "fr", "rare"), (1003, words(60), "fr", None), (1004, bad, None, "big"), (1005, bad, "en", None)]
    got = {r.doc_id: r.kept for r in outliers.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and {i for i, k in got.items() if not k} == {1000, 1002, 1004, 1005}


def test_rules_odd_rows(odd, none):
    clash = odd.withColumn("distance", F.lit(1)).withColumn("_docs", F.lit("x")).withColumn("group", F.lit("y"))
    kept = outliers.kept(clash)
    assert kept.columns == clash.columns and sorted(key(r.doc_id) for r in kept.collect()) == [-1, 1, 2, 2]
    assert outliers.digest(none).count() == 0 and outliers.kept(none).count() == 0


# Licences

def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for label, phrase in licenses.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licenses_against_brute_force(spark, small, odd):
    more = spark.createDataFrame([(1, "mit license MIT-License, apache license. cc by cc by " * 3), (2, "x " * 50 + "This work is licensed under the GNU General Public License, version 3")], "doc_id long, text string")
    for docs in (table(spark, small, "documents"), odd, more):
        texts = [(key(r.doc_id), r.text) for r in docs.collect()]
        rows = licenses.digest(docs).collect()
        got = sorted(((key(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str)
        assert got == sorted(((d, *brute_license(t)) for d, t in texts), key=str)
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    assert next(r.labels for r in rows if r.doc_id == 2) == "gpl,gpl-3.0"


def brute_labels(text):
    words, found = re.findall("[a-z0-9]+", text.lower()), set()
    for label, phrase, notice in [(a, b, b) for a, b in licenses.BASE] + list(licenses.NOTICES):
        at, key = notice.split(), phrase.split()
        k = next(i for i in range(len(at)) if at[i:i + len(key)] == key)
        for i in range(len(words)):
            if words[i:i + len(key)] == key and sum(0 <= i - k + j < len(words) and words[i - k + j] == w for j, w in enumerate(at)) >= licenses.ENOUGH * len(at):
                found.add(label)
    return ",".join(sorted(found))


def test_every_notice_of_a_file_is_found(spark, small):
    every = [n for _, _, n in licenses.NOTICES]
    texts = [f"{a}. And {b}!" for a in every for b in every] + [" / ".join(every), " ".join(every[::-1]), "any copy files charge binary domain associated documentation " + every[2], "GNU General Public License, version 3", "gnu general public license version 3 " * 2]
    texts += [" ".join(sorted({w for n in every for w in n.split()})) + ". " + n for n in every]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.digest(docs).collect()} == {i: brute_labels(t) for i, t in enumerate(texts)}
    assert "gpl-3.0" in brute_labels(f"{every[5]} {every[2]}").split(",") and len(brute_labels(texts[len(every) ** 2]).split(",")) == len(every) + len(licenses.BASE)


def test_work_grows_with_the_text(spark):
    import time

    docs = spark.createDataFrame([(1, "mit license " * 100_000), (2, "either version 3 of the license or at your option any later version " * 5_000)], "doc_id long, text string")
    began = time.time()
    one, two = licenses.digest(docs).orderBy("doc_id").collect()
    assert time.time() - began < 60 and one.n_base == 100_000 and one.labels == "mit"
    assert (one.first_word, one.last_word, one.score) == (0, 199_998, 1.0) and two.labels == ""


def test_no_licenses(none):
    assert licenses.digest(none).count() == 0


# Media

def test_media_round_trip(odd, none):
    texts = sorted((key(r.doc_id), r.text or "") for r in odd.collect())
    rows = sorted(media.digest(odd).collect(), key=lambda r: (key(r.doc_id), r.n_bytes))
    for (d, t), r in zip(texts, rows):
        raw = t.encode()
        payload = raw + b" " * (-len(raw) % 192) or b" " * 192
        assert (key(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert len({r.media_sha256 for r in rows if r.doc_id in (1, 2)}) == 1
    assert media.digest(none).count() == 0


def test_all_filters_and_damage():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (10, 7)).astype(np.uint8)
    lines = []
    for i, row in enumerate(image.astype(int)):
        up = image[i - 1].astype(int) if i else np.zeros(7, int)
        line = [i % 5]
        for j, x in enumerate(row):
            a, b, c = (row[j - 1] if j else 0), up[j], (up[j - 1] if j else 0)
            near = a + b - c
            guess = [0, a, b, (a + b) // 2, min((abs(near - a), 0, a), (abs(near - b), 1, b), (abs(near - c), 2, c))[2]][i % 5]
            line.append((x - guess) % 256)
        lines.append(line)
    assert (media.unfiltered(np.array(lines, np.uint8)) == image).all()
    data = media.png(image)
    assert (media.samples(data) == image).all()
    for k in (0, 20, len(data) // 2, len(data) - 3):
        with pytest.raises(ValueError):
            media.samples(data[:k] + bytes([data[k] ^ 1]) + data[k + 1:])


# Mixing

def test_mixing_against_its_closed_form(spark, small, odd):
    for docs in (table(spark, small, "documents"), odd):
        rows = mixing.mixed(docs).collect()
        sizes = Counter()
        for r in rows:
            sizes[r.source] += r.size
        want = mixing.targets(dict(sizes))
        assert len(rows) == docs.count() and abs(float(sum(want.values())) - sum(sizes.values())) < 1e-6
        for r in rows:
            goal, whole = int(want[r.source]), sizes[r.source]
            times = 0 if not whole else goal // whole * r.size + max(0, min(r.from_word + r.size, goal % whole) - r.from_word)
            assert r.taken == times <= 3 * r.size and r.target == float(want[r.source])


def test_targets_are_capped_and_reshared():
    got = mixing.targets({"a": 10, "b": 1000, None: 1000})
    assert list(got.values())[0] == 30 and sum(got.values()) == 2010 and max(got["b"], got[None]) <= 3000


def test_mixing_reruns_agree(spark, small):
    docs = table(spark, small, "documents")
    take = lambda d: sorted((r.doc_id, r.taken) for r in mixing.digest(d).collect())
    assert take(docs) == take(docs.repartition(7))


def test_repeats_follow_the_schedule(spark, small):
    docs = table(spark, small, "documents").withColumn("copies", F.lit(1)).withColumn("_mix_slot", F.lit("x")).withColumn("Slots", F.lit(2))
    out = mixing.repeated(docs)
    assert out.columns == docs.columns and "Range" in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.withColumn("_part", F.spark_partition_id()).collect()
    want, source = {}, {}
    for r in mixing.mixed(docs).collect():
        # The stream is taken round after round, the last one up to some word.
        want[r.doc_id], source[r.doc_id] = sum(2 * min(r.size, max(0, r.taken - e * r.size)) > r.size for e in range(mixing.MOST)), r.source
    assert Counter(r.doc_id for r in rows) == Counter({d: n for d, n in want.items() if n})
    # Any stretch of the output holds the sources about as they stand in the whole.
    rows.sort(key=lambda r: r._part)
    share = lambda part: Counter({s: n / len(part) for s, n in Counter(r.source for r in part).items()})
    whole = share(rows)
    for part in (rows[:len(rows) // 2], rows[len(rows) // 2:]):
        assert all(abs(share(part)[s] - n) < 0.06 for s, n in whole.items())


def test_repeated_ids_and_alike_rows_in_the_mix(spark):
    rows = [(None, f"one two {i % 3}", "a") for i in range(60)] + [(1, "same text here", "b")] * 50 + [(i, "x y z w", None) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed(docs).collect()
    assert len(out) == len(rows) and all(r.taken <= 3 * r.size for r in out)
    sums = Counter()
    for r in out:
        sums[r.source] += r.taken
    assert all(abs(sums[r.source] - r.target) < 1 for r in out)
    take = lambda d: Counter((r.doc_id, r.taken) for r in mixing.digest(d).collect())
    assert take(docs) == take(docs.repartition(5))


def test_no_plan_of_the_mix_holds_the_schedule_twice(spark, small):
    _, sources = mixing.placed(table(spark, small, "documents"))
    assert mixing.schedule(spark, sources)._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_mixing_odd_rows(odd, none):
    assert mixing.repeated(odd).columns == odd.columns
    assert mixing.digest(none).count() == 0 and mixing.repeated(none).count() == 0
    assert {(r.size, r.target, r.taken) for r in mixing.digest(odd.where("doc_id in (3, 4, 5)")).collect()} == {(0, 0.0, 0)}


def test_mixing_of_many_sources(spark):
    """Thirty thousand sources, most of them capped, against the exact rule."""
    rng = np.random.default_rng(2)
    n = 30_000
    rows = [(i, "w " * int(rng.integers(0, 4) if i % 7 else rng.integers(20, 60)), None if i == 5 else f"s{i * 7919 % n:05d}é{i % 3}") for i in range(n)] + [(n + i, "x y z " * 40, "s00000é0") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mixing.mixed(docs).collect()
    sizes = Counter()
    for r in out:
        sizes[r.source] += r.size
    want = mixing.targets(dict(sizes))
    capped = sum(want[s] == 3 * sizes[s] for s in want)
    assert len(out) == len(rows) and len(want) > 29_000 and 100 < capped < len(want) - 100
    for r in out:
        goal, whole = int(want[r.source]), sizes[r.source]
        times = 0 if not whole else goal // whole * r.size + max(0, min(r.from_word + r.size, goal % whole) - r.from_word)
        assert (r.taken, r.target) == (times, float(want[r.source]))


# Classifier

def test_classifier_on_held_out_rows(spark, small):
    small = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in table(spark, small, "labels").collect()}
    rows = [r for r in classifier.digest(table(spark, small, "documents"), table(spark, small, "labels")).collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.97


def test_classifier_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    rows = classifier.digest(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert classifier.digest(none, labels).count() == 0 and classifier.kept(odd, labels.where("false")).columns == odd.columns
    assert {r.score for r in classifier.digest(odd, labels.where("false")).collect()} == {0.5}


def test_repeated_ids_are_learned_from_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(classifier, "trained", lambda x, y: seen.append((x.tolist(), y.tolist())))
    rows = [(i, f"text {k} of {i}" + " word!" * k) for i in range(20) for k in range(6)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        classifier.learned(docs, labels, 10)
        found = classifier.sampled(docs, labels, 10).collect()
        assert len(found) == len({r.doc_id for r in found}) == len(seen[-1][1]) == 10
    assert seen[0] == seen[1]


def test_tables_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, len(classifier.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert np.mean((classifier.trained(x, y).scores(x) > 0.5) == y) > 0.95


# Shards

def test_shards_against_brute_force(spark, small):
    docs, limit = table(spark, small, "documents"), 40_000
    rows = sharding.sharded(docs, limit).collect()
    bits = {r.doc_id: "".join(f"{int(c, 16):04b}" for c in hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15]) for r in rows}
    size = {r.doc_id: len((r.text or "").encode()) for r in docs.collect()}

    def split(ids, depth):
        if sum(size[i] for i in ids) <= limit or len(ids) == 1:
            return {i: bits[i][:depth] for i in ids}
        return {k: v for b in "01" for k, v in split([i for i in ids if bits[i][depth] == b], depth + 1).items()} if ids else {}
    assert {r.doc_id: r.shard for r in rows} == split(list(bits), 0)


def test_shards_odd_rows(odd, none):
    for limit in (1, 200, 1 << 20):
        rows = sharding.sharded(odd, limit).collect()
        assert len(rows) == odd.count()
        sums, n = Counter(), Counter()
        for r in rows:
            sums[r.shard] += r.n_bytes
            n[r.shard] += 1
        assert all(sums[s] <= limit or n[s] == 1 for s in sums)
    assert sharding.digest(none).count() == 0


def test_written_shards_keep_the_limit(spark, odd, tmp_path):
    rows = [(1, "x" * 60)] * 40 + [(None, "y" * 61)] * 40 + [(i, "z" * 20) for i in range(20)] + [(2, f"text {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, table_, limit in (("a", docs, 200), ("b", odd, 200), ("c", docs, 10_000)):
        path = f"{tmp_path}/{name}"
        sharding.write_shards(table_, f"file://{path}", limit)
        back = spark.read.parquet(f"file://{path}")
        assert sorted(map(str, back.select(*table_.columns).collect())) == sorted(map(str, table_.collect()))
        sums = back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"), F.count("*").alias("n")).collect()
        assert all(r.b <= limit or r.n == 1 for r in sums)
        want = Counter((r.shard, r.shard_bytes) for r in sharding.sharded(table_, limit).select("shard", "shard_bytes").distinct().collect())
        assert Counter((r.shard[1:], r.b) for r in sums) == want
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("Shard", F.lit(1)), f"file://{tmp_path}/d")
