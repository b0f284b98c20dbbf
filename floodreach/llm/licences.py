"""Licence scans by sentence rules.

A text is cut at the ends of sentences, at colons that end a line and at blank lines (also those of a comment, which hold signs only).
Each piece is normalised, so that hard-wrapped notices and comment leaders become single spaces and the number of a list item goes, and is
looked up in a table of known licence sentences; of a piece that is none, every line is looked up by itself. What is recognised is, in text order, a sequence of one-letter identifiers. Ordered rules are then matched against the sequence: the longest and most
specific first, and what a rule matches is consumed before the next one is tried, so the head of a full licence text is not
reported again as a mere reference. Identifiers no rule consumes are reported as left over.

Scale: expressions of a single projection, without a shuffle or a join; tables of sentences and rules are fixed.

Defined cases: null and empty texts have no sentences and the verdict ``none``; identifiers without any rule give ``unknown``; repeated
rows are judged each on its own; an empty table gives an empty one; long texts are handled whole, in memory in proportion to the
text; rules are tried in their order, so there are no ties; columns beside doc_id and text are not read. Words cut by hyphens at a
line's end are not put together."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Known licence sentences, normalised, and their identifiers
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "M",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "N",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "O",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "B",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "S",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "R",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "E",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "D",
    "licensed under the apache license version 2 0": "A",
    "licensed under the apache license version 2 0 the license": "A",
    "you may not use this file except in compliance with the license": "F",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "L",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "W",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "W",
    "this work is licensed under the gnu general public license version 3": "V",
    "released under the mit license": "T",
    "licensed under the mit license": "T",
    "licensed under cc by nc 4 0": "X",
    "licensed under cc by 4 0": "Y",
    "licensed under cc by sa 4 0": "Z",
    "all rights reserved": "P",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "i",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "z",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "d",
    "this is free and unencumbered software released into the public domain": "u",
    "distributed under the boost software license version 1 0": "b",
    "this software is provided as is without any express or implied warranty": "y",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "k",
    "this source code form is subject to the terms of the mozilla public license v": "m",  # the sentence is cut behind its abbreviation
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "e",
    "do what the fuck you want to public license": "w",
}
# Licences that a notice of the free software foundation names, version, identifier
NOTICES = [("general", "2", "g"), ("general", "3", "G"), ("lesser general", "2 1", "l"), ("lesser general", "3", "n"), ("affero general", "3", "a")]
# Names of licences in tags, identifier, kind of licence
TAGS = [
    ("MIT", "T", "permissive"), ("Apache-2.0", "A", "permissive"), ("BSD-2-Clause", "2", "permissive"), ("BSD-3-Clause", "3", "permissive"), ("ISC", "i", "permissive"),
    ("0BSD", "z", "permissive"), ("Zlib", "k", "permissive"), ("Unlicense", "u", "permissive"), ("BSL-1.0", "b", "permissive"), ("MIT-0", "1", "permissive"),
    ("NCSA", "c", "permissive"), ("PostgreSQL", "p", "permissive"), ("Artistic-2.0", "r", "permissive"), ("WTFPL", "w", "permissive"), ("CC0-1.0", "0", "permissive"),
    ("CC-BY-4.0", "Y", "permissive"), ("MPL-2.0", "m", "copyleft"), ("EPL-2.0", "e", "copyleft"), ("EUPL-1.2", "x", "copyleft"), ("CDDL-1.0", "4", "copyleft"),
    ("OFL-1.1", "o", "copyleft"), ("GPL-2.0-only", "v", "copyleft"), ("GPL-2.0-or-later", "g", "copyleft"), ("GPL-3.0-only", "V", "copyleft"), ("GPL-3.0-or-later", "G", "copyleft"),
    ("LGPL-2.1-only", "t", "copyleft"), ("LGPL-2.1-or-later", "l", "copyleft"), ("LGPL-3.0-only", "q", "copyleft"), ("LGPL-3.0-or-later", "n", "copyleft"),
    ("AGPL-3.0-only", "h", "copyleft"), ("AGPL-3.0-or-later", "a", "copyleft"), ("CC-BY-SA-4.0", "Z", "copyleft"), ("CC-BY-ND-4.0", "f", "noderivatives"),
    ("CC-BY-NC-4.0", "X", "noncommercial"), ("CC-BY-NC-SA-4.0", "5", "noncommercial"), ("CC-BY-NC-ND-4.0", "6", "noncommercial"),
]
# Rules for sequences, in order; licence, identifiers that must follow each other, kind of licence
SEQUENCES = [
    ("BSD-3-Clause", "BSRED", "permissive"),
    ("BSD-3-Clause", "BSRE", "permissive"),
    ("BSD-2-Clause", "BSRD", "permissive"),
    ("MIT", "MNO", "permissive"),
    ("BSD-2-Clause", "BSR", "permissive"),
    ("Apache-2.0", "AFL", "permissive"),
    ("MIT-0", "MO", "permissive"),
    ("ISC", "id", "permissive"),
    ("0BSD", "zd", "permissive"),
    ("Zlib", "yk", "permissive"),
    ("GPL-2.0-or-later", "gW", "copyleft"),
    ("GPL-3.0-or-later", "GW", "copyleft"),
    ("LGPL-2.1-or-later", "lW", "copyleft"),
    ("LGPL-3.0-or-later", "nW", "copyleft"),
    ("AGPL-3.0-or-later", "aW", "copyleft"),
]


def _tag(name: str) -> str:
    return "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower())


SENTENCES = TEXTS | {_tag(name): letter for name, letter, _ in TAGS} | {
    f"this {what} is free software you can redistribute it and or modify it under the terms of the gnu {name} public license as published by the free software foundation either version {version} of the license or at your option any later version": letter
    for name, version, letter in NOTICES for what in ("program", "library")}
RULES = SEQUENCES + [(name, letter, kind) for name, letter, kind in TAGS] + [("proprietary", "P", "proprietary")]
STRICTEST = ["proprietary", "noncommercial", "noderivatives", "copyleft", "permissive"]
_SIGNS = r"\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # of ASCII, above the newline; texts are lower-cased
_CUT = rf"[.!?][ \t\r\n]+|:[ \t\r]*\n|\n[\x00-\x09{_SIGNS}]*\n"
_APART, _ITEM = rf"[\x00-\x0A{_SIGNS}]+", "^ ?(?:[0-9]{1,2}|[a-d]|i{1,3}|iv) "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def identifiers(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The identifiers of a text's known sentences, in order, as one string."""
    table = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)

    def known(piece: Column) -> Column:
        return F.try_element_at(table, F.trim(F.regexp_replace(F.regexp_replace(piece, _APART, " "), _ITEM, "")))

    def lines(piece: Column) -> Column:
        return F.when(F.contains(piece, F.lit("\n")), F.array_join(F.transform(F.split(piece, "\n"), known), "")).otherwise("")
    found = F.transform(F.split(plain, _CUT), lambda s: F.coalesce(known(s), lines(s)))
    return F.array_join(found, "")


def match(sequence: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column, Column]:
    """Licences found (distinct, in rule order), their kinds, and the identifiers left over."""
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("pattern"), F.lit(kind).alias("kind")) for name, pattern, kind in rules])
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("names"), F.array().cast("array<string>").alias("kinds"))

    def tried(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["pattern"])
        grown = [F.when(hit, F.concat(state[many], F.array(rule[one]))).otherwise(state[many]).alias(many) for many, one in (("names", "name"), ("kinds", "kind"))]
        return F.struct(F.replace(state["rest"], rule["pattern"], F.lit("|")).alias("rest"), *grown)
    end = F.when(sequence == "", start).otherwise(F.aggregate(table, start, tried))  # most texts have nothing to match
    return F.array_distinct(end["names"]), F.array_distinct(end["kinds"]), F.replace(end["rest"], F.lit("|"), F.lit(""))


def scan_licences(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """doc_id, identifiers, licences (array), left_over and verdict: the strictest kind found, ``unknown`` or ``none``."""
    found = docs.select("doc_id", identifiers(F.col("text"), sentences).alias("identifiers"))
    licences, kinds, rest = match(F.col("identifiers"), rules)
    verdict = F.when(F.col("identifiers") == "", "none").otherwise("unknown")
    for kind in reversed(STRICTEST):
        verdict = F.when(F.array_contains("_kinds", kind), kind).otherwise(verdict)
    out = found.select("doc_id", "identifiers", licences.alias("licences"), kinds.alias("_kinds"), rest.alias("left_over"))
    return out.select("doc_id", "identifiers", "licences", "left_over", verdict.alias("verdict"))


def judge(docs: DataFrame) -> DataFrame:
    return scan_licences(docs).withColumn("licences", F.array_join("licences", ","))


def sql() -> str:
    """The same in DuckDB's SQL, from the same tables."""
    table = "MAP {" + ", ".join(f"'{s}': '{i}'" for s, i in SENTENCES.items()) + "}"
    rest, hits = "identifiers", []
    for name, pattern, kind in RULES:
        hits.append((name, kind, f"contains({rest}, '{pattern}')"))
        rest = f"replace({rest}, '{pattern}', '|')"
    names = list(dict.fromkeys(n for n, _, _ in hits))
    licences = ", ".join(f"CASE WHEN {' OR '.join(h for n, _, h in hits if n == name)} THEN '{name}' END" for name in names)
    verdict = " ".join(f"WHEN {' OR '.join(h for _, k, h in hits if k == kind)} THEN '{kind}'" for kind in STRICTEST)
    plain = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

    def known(piece: str) -> str:
        return f"{table}[trim(regexp_replace(regexp_replace({piece}, '{_APART}', ' ', 'g'), '{_ITEM}', ''))]"
    return rf"""
WITH s AS (SELECT doc_id, unnest(string_split_regex({plain}, '{_CUT}')) AS x, generate_subscripts(string_split_regex({plain}, '{_CUT}'), 1) AS pos FROM documents),
n AS (SELECT doc_id, pos, {known('x')} AS whole, x FROM s),
l AS (SELECT doc_id, pos, 0 AS line, whole AS i FROM n WHERE whole IS NOT NULL UNION ALL
      SELECT doc_id, pos, line, {known('y')} FROM (SELECT doc_id, pos, unnest(string_split(x, chr(10))) AS y, generate_subscripts(string_split(x, chr(10)), 1) AS line FROM n WHERE whole IS NULL)),
q AS (SELECT doc_id, coalesce(string_agg(i, '' ORDER BY pos, line), '') AS identifiers FROM l GROUP BY 1)
SELECT doc_id, identifiers, array_to_string(list_filter([{licences}], lambda v: v IS NOT NULL), ',') AS licences, replace({rest}, '|', '') AS left_over,
       CASE {verdict} WHEN identifiers = '' THEN 'none' ELSE 'unknown' END AS verdict FROM q
"""
