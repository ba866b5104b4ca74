"""Licence scans by sentence and rule, with DataFrame functions alone."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_APACHE_WARRANTY = "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"

#: Known licence sentences, as normalised: fixed values. Identifier, sentence.
SENTENCES = (
    ("mit-name", "released under the mit license"),
    ("mit-name", "licensed under the mit license"),
    ("mit-name", "this project is licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-name", "licensed under the apache license version 2 0"),
    ("apache-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    # The same as it is usually written: sentences are cut at ':' and ';' too, and a comment's empty lines are no blank ones.
    ("apache-name", "licensed under the apache license version 2 0 the license"),
    ("apache-use", "you may not use this file except in compliance with the license"),
    *(("apache-warranty", f"you may obtain a copy of the license at {at} www apache org licenses license 2 0 " + _APACHE_WARRANTY) for at in ("http", "https")),
    ("apache-copy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-warranty", _APACHE_WARRANTY),
    ("apache-terms", "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl3-name", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-name", "licensed under the gnu general public license version 3"),
    ("gpl-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-free", "this program is free software"),
    *((f"gpl{v}-terms", f"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {v} of the license or at your option any later version") for v in (2, 3)),
    ("gpl-useful", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-merchant", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-details", "see the gnu general public license for more details"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-name", "licensed under cc by 4 0"),
    ("cc-by-name", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-name", "licensed under cc by sa 4 0"),
    ("cc-by-nc-name", "licensed under cc by nc 4 0"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    # Cut after 'v.'; only version 2.0 speaks of a Source Code Form.
    ("mpl-form", "this source code form is subject to the terms of the mozilla public license v"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
)


class LicenceRule(NamedTuple):
    """A licence and the sentence identifiers that state it, in order."""

    rule: str
    licence: str
    steps: tuple[str, ...]


#: Ordered licence rules: fixed values. A rule may stand more than once, for sentences whole and in parts.
LICENCE_RULES = (
    LicenceRule("mit-text", "MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    LicenceRule("mit-named", "MIT", ("mit-name",)),
    LicenceRule("apache-text", "Apache-2.0", ("apache-header", "apache-warranty", "apache-terms")),
    LicenceRule("apache-text", "Apache-2.0", ("apache-name", "apache-use", "apache-warranty", "apache-terms")),
    LicenceRule("apache-named", "Apache-2.0", ("apache-name",)),
    LicenceRule("gpl3-text", "GPL-3.0-or-later", ("gpl-later", "gpl-warranty", "gpl-details")),
    LicenceRule("gpl2-text", "GPL-2.0-or-later", ("gpl2-later", "gpl-warranty", "gpl-details")),
    LicenceRule("gpl3-text", "GPL-3.0-or-later", ("gpl-free", "gpl3-terms", "gpl-useful", "gpl-merchant", "gpl-details")),
    LicenceRule("gpl2-text", "GPL-2.0-or-later", ("gpl-free", "gpl2-terms", "gpl-useful", "gpl-merchant", "gpl-details")),
    LicenceRule("gpl3-named", "GPL-3.0", ("gpl3-name",)),
    LicenceRule("bsd3-text", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    LicenceRule("bsd2-text", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    LicenceRule("cc-by-named", "CC-BY-4.0", ("cc-by-name",)),
    LicenceRule("cc-by-sa-named", "CC-BY-SA-4.0", ("cc-by-sa-name",)),
    LicenceRule("cc-by-nc-named", "CC-BY-NC-4.0", ("cc-by-nc-name",)),
    LicenceRule("isc-text", "ISC", ("isc-grant",)),
    LicenceRule("mpl-text", "MPL-2.0", ("mpl-form",)),
    LicenceRule("unlicense-text", "Unlicense", ("unlicense",)),
    LicenceRule("reserved-named", "proprietary", ("reserved",)),
)


def anchors(sentences) -> list[str]:
    """Few words of which every known sentence holds one: no other text can match."""
    left, chosen = [set(s.split()) for _, s in sentences], []
    while left:
        words = {w for s in left for w in s}
        best = max(sorted(words), key=lambda w: (sum(w in s for s in left) * (len(w) > 4), len(w)))
        chosen.append(best)
        left = [s for s in left if best not in s]
    return sorted(chosen)


def normalised(sentence: Column) -> Column:
    """Lower case, ASCII letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^a-z0-9]+", " "))


def licence_sentences(documents: DataFrame, sentences=SENTENCES) -> DataFrame:
    """(doc_id, text_hash, sentence_no, line_no, sentence_id): each known sentence of each text.

    Sentences end at ``.``, ``!``, ``?``, ``:`` or ``;`` before white space, and at
    blank lines. A sentence of several lines is looked up whole (line_no 0) and line
    by line (from 1), so a licence line is found in prose without full stops. Only
    what is looked up leaves the scan; texts are never shuffled.
    """
    spark = documents.sparkSession
    known = spark.createDataFrame(list(sentences), "sentence_id string, sentence string").dropDuplicates(["sentence"])
    anchor = "(?i)" + "|".join(re.escape(w) for w in anchors(sentences))
    marked = F.regexp_replace("text", r"([.!?:;])[ \t\r\n]+|(?:[ \t\r]*\n){2,}", "$1\u0001")
    lines = F.split("whole", r"[\r\n]+")
    parts = F.when(F.size(lines) > 1, F.concat(F.array(F.col("whole")), lines)).otherwise(F.array(F.col("whole")))
    return (
        documents.select("doc_id", "text")
        .where(F.col("text").rlike(anchor))
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(marked, "\u0001")).alias("sentence_no", "whole"))
        .where(F.col("whole").rlike(anchor))
        .select("doc_id", "text_hash", "sentence_no", F.posexplode(parts).alias("line_no", "part"))
        .select("doc_id", "text_hash", "sentence_no", "line_no", normalised(F.col("part")).alias("sentence"))
        .join(F.broadcast(known), "sentence")
        .select("doc_id", "text_hash", "sentence_no", "line_no", "sentence_id")
    )


def scan_licences(documents: DataFrame, sentences=SENTENCES, rules=LICENCE_RULES) -> DataFrame:
    """(doc_id, rule, licence, n_steps, first_sentence, last_sentence) of every rule met.

    A document's known sentences, in reading order, are one sequence of identifiers. A
    rule is met if its steps are in that sequence in order, other sentences between
    them allowed. A rule whose steps another met rule of more steps contains is left
    out. The sentences counted are those from the first of the first step to the last
    of the last.

    The sentence table is a constant of the program, so its broadcast is bounded.
    Null and empty texts, and an empty table, give no rows; of rows that repeat a doc_id
    each different text is read by itself; other columns are not read.
    """
    found = licence_sentences(documents, sentences).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("sentence_no", "line_no", "sentence_id"))).alias("hits"))
    # The rules as one constant array, so that the plan does not grow with their number.
    table = F.array(
        *[
            F.struct(
                F.lit(r.rule).alias("rule"),
                F.lit(r.licence).alias("licence"),
                F.array(*[F.lit(s) for s in r.steps]).alias("steps"),
            )
            for r in rules
        ]
    )
    # One pass over the sequence: how many of a rule's steps it has had so far, in order.
    taken = lambda r: F.aggregate("hits", F.lit(0), lambda n, h: n + F.coalesce(F.get(r["steps"], n) == h["sentence_id"], F.lit(False)).cast("int"))
    met = found.withColumn("met", F.filter(table, lambda r: taken(r) == F.size(r["steps"])))
    contained = lambda r: F.exists("met", lambda x: (F.size(x["steps"]) > F.size(r["steps"])) & (F.size(F.array_except(r["steps"], x["steps"])) == 0))
    rule = F.col("r")
    at = lambda step: F.transform(F.filter("hits", lambda h: h["sentence_id"] == step), lambda h: h["sentence_no"])
    return met.select("doc_id", "hits", F.explode(F.filter("met", lambda r: ~contained(r))).alias("r")).select(
        "doc_id",
        "r.rule",
        "r.licence",
        F.size(rule["steps"]).alias("n_steps"),
        F.array_min(at(F.element_at(rule["steps"], 1))).alias("first_sentence"),
        F.array_max(at(F.element_at(rule["steps"], -1))).alias("last_sentence"),
    )
