"""Licence scan by a positional index of rare words.

Each notice, base phrases among them, is stored as ANCHORS postings (word, notice, place): the words of its key phrase with
the highest inverse document frequency, counted over the whole corpus. Each place of an anchor in a file, less its place in
the notice, is where the notice would start, and starts on which all anchors of a notice agree are candidates. A candidate is
verified: its words are looked up by their places in the file, a row a word, so work grows with the text and not with its
square. The key phrase must stand word for word, and the score, the share of the notice's words that stand in
place, must reach ENOUGH. A key phrase in place has all its anchors in place, so every place of every notice is found,
however many notices and licence words a file has. It is all DataFrame expressions; the index has ANCHORS rows a
notice, so its size doesn't depend on the data.

Cases: null and empty texts have no words, no labels ('') and score 0; repeated and null doc_ids are files of their
own; long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bahikhata.llm.common import ascii_lower, text_of, written

#: Words that the base contract and well-known public notices use. (label, key phrase, notice).
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
NOTICES = (
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("gpl-2.0", "gnu general public license version 2", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license"),
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license"),
    ("mit-text", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", "mit license", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "eclipse public license", "made available under the terms of the eclipse public license"),
    ("cc-by-4.0", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "licensed under cc by nd 4 0"),
    ("cc0-1.0", "cc0 1 0", "cc0 1 0 universal public domain dedication"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("apache-2.0-header", "you may not use this file except in compliance with the license",
     "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
     "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing "
     "permissions and limitations under the license"),
    ("gpl-2.0-or-later", "either version 2 of the license or at your option any later version",
     "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the "
     "hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl-3.0-or-later", "either version 3 of the license or at your option any later version",
     "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the "
     "hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl-2.1-or-later", "either version 2 1 of the license or at your option any later version",
     "it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in "
     "the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("agpl-3.0-or-later", "gnu affero general public license as published by the free software foundation",
     "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the "
     "hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details"),
    ("mit-full", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
     "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom "
     "the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the "
     "software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event "
     "shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the "
     "use or other dealings in the software"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice",
     "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list "
     "of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission",
     "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and "
     "contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc-full", "the software is provided as is and the author disclaims all warranties with regard to this software",
     "provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all "
     "implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or "
     "profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "permission is granted to anyone to use this software for any purpose",
     "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to "
     "use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented "
     "you must not claim that you wrote the original software"),
    ("bsl-1.0", "to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
     "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display "
     "distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so"),
    ("mpl-2.0-header", "if a copy of the mpl was not distributed with this file",
     "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense-full", "anyone is free to copy modify publish use compile sell or distribute this software",
     "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in "
     "jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document",
     "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("cc-by-deed", "you must give appropriate credit provide a link to the license and indicate if changes were made",
     "you must give appropriate credit provide a link to the license and indicate if changes were made you may do so in any reasonable manner but not in any way that suggests the licensor endorses you or your use"),
)
#: Words of each key phrase that are looked up; every phrase has as many places.
ANCHORS = 2
#: Share of a notice's words that must stand in place.
ENOUGH = 0.5
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ALL = [(label, phrase, phrase, True) for label, phrase in BASE] + [(*n, False) for n in NOTICES]
_VOCABULARY = sorted({w for _, _, notice, _ in _ALL for w in notice.split()})


def _words(text: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in text])


def scanned(docs: DataFrame) -> DataFrame:
    """file (unique), doc_id, n_words, hits (its licence words), places (word, i) if it holds all words of a key phrase."""
    words = F.filter(F.split(ascii_lower(text_of()), _GAP), lambda w: w != "")
    rows = docs.select("doc_id", words.alias("w"))
    rows = rows.select("doc_id", "w", F.size("w").cast("long").alias("n_words"), F.array_intersect("w", _words(_VOCABULARY)).alias("hits"))
    may = F.lit(False)
    for phrase in sorted({tuple(sorted(set(p.split()))) for _, p, _, _ in _ALL}):
        may = may | (F.size(F.array_except(_words(list(phrase)), "hits")) == 0)
    places = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(_VOCABULARY))
    return rows.select(F.monotonically_increasing_id().alias("file"), "doc_id", "n_words", "hits", F.when(may, places).alias("places"))


def _key(notice: str, phrase: str) -> int:
    """Place of the key phrase in its notice."""
    at = notice.split()
    return next(i for i in range(len(at)) if at[i:i + len(phrase.split())] == phrase.split())


def postings(idf: dict[str, float]) -> list[tuple[str, int, int]]:
    """Postings: word, notice, place; of each notice's key phrase the ANCHORS places with the rarest words."""
    rows = []
    for n, (_, phrase, notice, _) in enumerate(_ALL):
        places = sorted(enumerate(phrase.split(), _key(notice, phrase)), key=lambda x: (-idf[x[1]], x[0]))
        rows += [(w, n, i) for i, w in places[:ANCHORS]]
    return rows


def notices(spark) -> DataFrame:
    """notice, label, base, words and key_words: the words of all of it and of its key phrase with their places."""
    rows = []
    for n, (label, phrase, notice, base) in enumerate(_ALL):
        words, key = list(enumerate(notice.split())), _key(notice, phrase)
        rows.append((n, label, base, words, words[key:key + len(phrase.split())]))
    return spark.createDataFrame(rows, "notice int, label string, base boolean, words array<struct<j int, w string>>, key_words array<struct<j int, w string>>")


def matches(files: DataFrame) -> DataFrame:
    """(file, label, base, start, score): every verified place of a notice."""
    spark = files.sparkSession
    total = files.count()
    # At most one row a word of the vocabulary.
    seen = {r["w"]: r["n"] for r in files.select(F.explode("hits").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    idf = {w: math.log((1 + total) / (1 + seen.get(w, 0))) for w in _VOCABULARY}
    found = files.where("places IS NOT NULL").select("file", F.explode("places").alias("p")).select("file", F.col("p.w").alias("w"), F.col("p.i").alias("i"))
    index = postings(idf)
    hit = found.where(F.col("w").isin(sorted({w for w, _, _ in index})))
    starts = hit.join(F.broadcast(spark.createDataFrame(index, "w string, notice int, place int")), "w").groupBy("file", "notice", (F.col("i") - F.col("place")).alias("start")).agg(F.count("*").alias("n"))
    starts = starts.where(F.col("n") == ANCHORS).join(F.broadcast(notices(spark)), "notice")
    # A row a word of each candidate, of its key phrase first: the few that hold it are looked at whole.
    for part, enough in (("key_words", F.col("n") == F.size("key_words")), ("words", F.col("n") >= ENOUGH * F.size("words"))):
        word = starts.select("file", "notice", "start", F.explode(part).alias("x")).select("file", "notice", "start", (F.col("start") + F.col("x.j")).alias("i"), F.col("x.w").alias("w"))
        in_place = word.join(found, ["file", "i", "w"]).groupBy("file", "notice", "start").agg(F.count("*").alias("n"))
        starts = in_place.join(F.broadcast(notices(spark)), "notice").where(enough)
    return starts.select("file", "label", "base", "start", (F.col("n") / F.size("words")).alias("score"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    files, _ = written(scanned(docs), "licence-words")
    base = F.col("base")
    by_file = matches(files).groupBy(F.col("file").alias("_file")).agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"))
    none = F.lit("")
    return files.select("file", "doc_id", "n_words").join(by_file, F.col("file") == F.col("_file"), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs)
