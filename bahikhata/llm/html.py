"""Main text of web pages by nearest-URL page differencing.

Every page is read into lines (block elements), each with a zone: main (inside the page's own article or main
element), dropped (menus, headers, footers, asides, forms, scripts and elements whose class, id or role names such
a part), or open (neither). A class or id names a part if all fragments of one of its tokens do, words of place and shape
aside (_NEUTRAL). An article, main or articleBody inside an element that is dropped for its class alone is main all the
same; an article inside comments, advertisements or related pages is main only if the page has no other.

All pages are sorted by URL path within their host (those with an article apart from the bare ones, whose layout is
another), pages with the same lines once, at the first of their paths. Each is held against the two nearest others, the one with the longer common path first: all lines of both pages, whatever
their zones, are aligned by longest common subsequence (of line hashes, so texts don't move), and lines shared with the
first are deleted as the site's template. The first is a copy, not a mere neighbour, if of the words that the second doesn't
share it has over COPY; then the lines shared with the second are deleted instead. So lines that stand on three
pages are template, however short the text beside them. On a host of two different pages nothing tells a copy from a
template, and a pair that shares over COPY of a page's words deletes nothing.

Zones guard what differencing can't know. Main lines stay, shared or not: copies and quoted passages on neighbouring pages would be
deleted from the article with the template. Of the lines that differ from the neighbours' those in a dropped zone go (menus
and adverts made for one page), and on a page with an article all lines outside it.

Cases: null or empty html gives an empty text; null urls are one host; a page alone on its host has no partner and
keeps its open lines; repeated page_ids are pages of their own; unclosed tags and comments run to where HTML ends
them; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bahikhata.llm.common import small_batches, written

COPY = 0.7
#: Pages that are held against their neighbours in one task.
STRETCH = 2_000
MAIN, OPEN, DROPPED = 1, 0, 2
#: While a page is read: dropped for a class or id alone; the same, for one that holds other articles; an article inside that.
_SOFT, _OTHERS, _SPARE = 3, 4, 5

#: A comment, a tag (quotes count only behind an equals sign; one that isn't closed is part of the value), or another declaration.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?>[^>=]++|=\s*+(?>"[^"]*+"|'[^']*+')?+)*+)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
           "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_PARTS = {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "math", "object", "canvas", "audio", "video"}
_SCOPES = {"div", "section", "article", "main", "td", "th", "li", "blockquote", "body", "html", "table", "figure"}
_NAMES = set("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar nav navbar
navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter
subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies
widget toolbar search copyright pagination pager""".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar", "tablist"}
_NEUTRAL = set("""left right top bottom upper lower main primary secondary site page global header footer nav bar box block wrap wrapper
container area region section inner outer list item items link links button buttons mobile desktop fixed sticky post posts articles stories""".split())
_NOT_ARTICLES = {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "sponsored", "promo", "related", "recommended"}


def _named(tokens: list[str], names: set[str]) -> bool:
    """Whether one of the tokens is made of names, and of neutral words beside them."""
    for token in tokens:
        parts = {x.lower() for x in _NAME.findall(token)}
        if parts & names and all(x in names or x in _NEUTRAL or len(x) == 1 or x.isdigit() for x in parts):
            return True
    return False


def _zone(tag: str, attributes: str, around: int) -> int:
    """Zone of an element's inside, by its markup and the zone around it."""
    inside = around in (MAIN, _SPARE)
    if around == DROPPED or tag in _PARTS or (tag == "header" and not inside):
        return DROPPED
    names, role, body = [], "", False
    if attributes.strip(" /\n\t\r"):
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id"):
                names += value.split()
            elif key == "role":
                role = value.strip().lower()
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                return DROPPED
            elif key == "itemprop" and "articlebody" in value.lower().split():
                body = True
    if tag in ("article", "main") or role in ("main", "article") or body:
        if _named(names, _NOT_ARTICLES):
            return _OTHERS
        return _SPARE if around in (_OTHERS, _SPARE) and tag != "main" and role != "main" else MAIN
    if tag in ("html", "body"):
        return around
    if role in _ROLES:
        return DROPPED
    if _named(names, _NOT_ARTICLES):
        return _OTHERS
    if around in (_SOFT, _OTHERS):
        return around
    return _SOFT if _named(names, _NAMES if inside else _NAMES | {"header"}) else around


def lines(page: str) -> list[tuple[str, int]]:
    """(text, zone) of every line of a page that has text; character references decoded, white space single."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    zone, held, at, end = OPEN, [], 0, len(page)

    def close() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((text, zone))

    while at < end:
        token = _TOKEN.search(page, at)
        stop = token.start() if token else end
        if stop > at:
            held.append(html.unescape(page[at:stop]))
        if not token:
            break
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            if tag not in _INLINE:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if (before := stack[i - 1][1] if i else OPEN) != zone:
                        close()
                    zone = before
                    del stack[i:]
                    break
            continue
        if tag in _RAW:
            ended = _RAW_END[tag].search(page, at)
            at = page.find(">", ended.end() - 1) + 1 or end if ended else end
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                held.append(" ")
            continue
        inline = tag in _INLINE
        if not inline:
            close()
            # A block ends an open paragraph, and a list item its sibling.
            ends = ("li",) if tag == "li" else ("p",)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    zone = stack[i - 1][1] if i else OPEN
                    del stack[i:]
                    break
                if stack[i][0] in _SCOPES or stack[i][0] in ("ul", "ol"):
                    break
        if token[3].endswith("/") and tag in ("svg", "math"):
            continue
        inside = _zone(tag, token[3], zone)
        if inside != zone:
            close()
        stack.append((tag, inside))
        zone = inside
    close()
    spare = DROPPED if any(z == MAIN for _, z in out) else MAIN
    return [(t, spare if z == _SPARE else DROPPED if z in (_SOFT, _OTHERS) else z) for t, z in out]


def shared(ours: list, theirs: list) -> set[int]:
    """Places in ``ours`` of a longest common subsequence of lines, a row of bits for each of our lines."""
    where: dict = {}
    for j, line in enumerate(theirs):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(theirs)) - 1
    rows = [full]
    for line in ours:
        v = rows[-1]
        u = v & where.get(line, 0)
        rows.append(((v + u) | (v - u)) & full)
    found, i, j = set(), len(ours), len(theirs)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.add(i)
    return found


def template(ours: list, sizes: list[int], first: list | None, second: list | None) -> list[int]:
    """Places of our lines (with so many words each) that are template, by the two nearest pages (None: there is none)."""
    size = lambda places: sum(sizes[i] for i in places)
    gone, other = shared(ours, first or []), shared(ours, second or [])
    if size(gone - other) > COPY * size(set(range(len(ours))) - other):
        gone = other
    return sorted(gone)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, keys and sizes (64-bit hash and words of every line), places and texts of the lines that may stay, marked (those are an article's), host, path and alike (which say what the page is held against)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [lines(x or "") for x in rows["html"]]
            marked = [any(z == MAIN for _, z in f) for f in found]
            stay = [[(i, t) for i, (t, z) in enumerate(f) if z == (MAIN if m else OPEN)] for f, m in zip(found, marked)]
            yield pd.DataFrame({"page_id": rows["page_id"].astype("Int64"), "url": rows["url"], "keys": [[np.int64(xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63)) for t, _ in f] for f in found],
                                "sizes": [[t.count(" ") + 1 for t, _ in f] for f in found], "places": [[i for i, _ in x] for x in stay], "texts": [[t for _, t in x] for x in stay], "marked": marked})
    schema = "page_id long, url string, keys array<long>, sizes array<int>, places array<int>, texts array<string>, marked boolean"
    url = F.coalesce("url", F.lit(""))
    # Pages with an article and bare pages of a host are two lists.
    host = F.concat(F.when(F.col("marked"), "article ").otherwise("bare "), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))
    path = F.rtrim(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), F.lit("/"))
    return pages.select("page_id", "url", "html").mapInPandas(run, schema).withColumns({"host": host, "path": path, "alike": F.xxhash64("keys")})


@F.pandas_udf(T.ArrayType(T.LongType()))
def _nearest(path: pd.Series, b2: pd.Series, b1: pd.Series, a1: pd.Series, a2: pd.Series, *pages: pd.Series) -> pd.Series:
    """The two neighbours with the longest common prefix, of two before and two after in order of paths; those before if equal."""
    out = []
    for p, *row in zip(path, b2, b1, a1, a2, *pages):
        near = [(-len(commonprefix([p, row[i]])), d, int(row[4 + i])) for d, i in enumerate((1, 2, 0, 3)) if row[i] is not None and row[i] == row[i]]
        out.append([page for _, _, page in sorted(near)[:2]])
    return pd.Series(out)


def partners(pages: DataFrame) -> DataFrame:
    """pages (page, host, path; no two alike on a host) -> (page, first, second): the nearest pages by path on the same host, or null.

    Keys alone are sorted, by ranges, and numbered through; stretches of STRETCH numbers, with two neighbours from either
    side, are windows of their own, so a host of any size spreads over many tasks.
    """
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = pages.select("page", "host", "path").repartitionByRange(n, "host", "path", "page").sortWithinPartitions("host", "path", "page")
    keys, _ = written(keys.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "page-order", thin=True)
    parts = keys.groupBy("part").agg(F.count("*").alias("n"))
    upto = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    keys = keys.join(F.broadcast(parts), "part").withColumn("at", F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1))
    stretch = lambda c: F.floor(c / STRETCH)
    keys = keys.withColumn("stretch", F.explode(F.array_distinct(F.array(*[stretch(F.col("at") + d) for d in (-2, 0, 2)]))))
    row = Window.partitionBy("stretch").orderBy("at")
    one = F.struct("host", "path", "page")
    keys = keys.select("*", *[F.lag(one, d).over(row).alias(f"n{d + 2}") for d in (2, 1, -1, -2)]).where(F.col("stretch") == stretch(F.col("at")))
    near = [F.when(F.col(f"n{d}.host") == F.col("host"), F.col(f"n{d}")) for d in (4, 3, 1, 0)]
    keys = keys.select("page", _nearest("path", *[x["path"] for x in near], *[x["page"] for x in near]).alias("near"))
    return keys.select("page", F.get("near", 0).alias("first"), F.get("near", 1).alias("second"))


def templates(found: DataFrame) -> DataFrame:
    """host, alike (a row for all pages of a host with the same lines), partner (page_id of the nearest page), template (places of the lines that differencing deletes)."""
    one = found.where("size(keys) > 0").select("host", "alike", "path", "page_id", "keys", "sizes")
    one = one.groupBy("host", "alike").agg(F.min(F.struct("path", "page_id", "keys", "sizes")).alias("one")).select("host", "alike", "one.*", F.monotonically_increasing_id().alias("page"))
    one, _ = written(one, "page-lines")
    near = partners(one).select("page", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.col("first").alias("other")), F.struct(F.lit(2).alias("rank"), F.col("second").alias("other")))).alias("x")).select("page", "x.*").where("other IS NOT NULL")
    # Merge joins at every size: a side that is small enough to send round today grows with the pages.
    near = near.hint("merge").join(one.select(F.col("page").alias("other"), F.col("keys").alias("other_keys"), F.col("page_id").alias("other_id")), "other")
    of = lambda rank, c: F.first(F.when(F.col("rank") == rank, F.col(c)), ignorenulls=True)
    near = near.groupBy("page").agg(of(1, "other_keys").alias("first_keys"), of(2, "other_keys").alias("second_keys"), of(1, "other_id").alias("first_id"))
    tried = one.select("page", "host", "alike", "keys", "sizes").join(near.hint("merge"), "page")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = [[None if x is None else list(x) for x in b[c]] for c in ("keys", "sizes", "first_keys", "second_keys")]
            yield pd.DataFrame({"host": b["host"], "alike": b["alike"], "partner": b["first_id"].astype("Int64"), "template": [template(*x) for x in zip(*held)]})
    each = tried.select("host", "alike", "keys", "sizes", "first_keys", "second_keys", "first_id").mapInPandas(run, "host string, alike long, partner long, template array<int>")
    return written(each, "page-templates")[0]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, partner (page_id of the page that it was held against), n_template (lines that differencing deleted).

    Pages are read twice, for their lines' hashes and for their texts: that costs less than keeping all texts between.
    """
    small_batches(pages.sparkSession)
    found = parsed(pages)
    of = templates(found)
    rows = found.select("page_id", "url", "places", "texts", "marked", "host", "alike").join(of.hint("merge"), ["host", "alike"], "left")
    gone = F.coalesce("template", F.array().cast("array<int>"))
    stays = F.filter("texts", lambda t, i: F.col("marked") | ~F.array_contains(F.col("_gone"), F.get("places", i)))
    rows = rows.withColumn("_gone", gone).withColumn("text", F.array_join(stays, " "))
    # Lines of an article stay; all others that are shared were deleted before zones were looked at.
    kept = F.when(F.col("marked"), F.size(F.array_intersect("_gone", "places"))).otherwise(0)
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "partner", (F.size("_gone") - kept).alias("n_template"))


def digest(pages: DataFrame) -> DataFrame:
    return main_text(pages)
