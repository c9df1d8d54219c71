"""License scans by recognising sentences.

A text is normalised and searched for known license sentences.  One counts where it begins and
ends at the bounds of a line or sentence; within it, the text may be wrapped at any word, with
comment marks before each line, but a blank line ends it.  The
identifiers found, in order, are matched against ordered license rules.  A rule is a
sequence of identifiers that must stand together, in this order; the rules are tried from
the most to the least specific, and identifiers that a rule has taken count for no other.

Row-local DataFrame functions only: no shuffle, no Python.

Defined results: a null or empty text has no sentences and no licenses; a known sentence
counts each time that it occurs; texts of any length are searched whole; repeated rows and null
doc_ids give a result each; there are no ties, as rules are tried in a fixed order; an empty table
gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import table

# Sentences of public licenses, normalised (lower case, letters and digits).
SENTENCES = {
    "M1": "released under the mit license",
    "M2": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "M3": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "M4": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "A1": "licensed under the apache license version 2 0",
    "A2": "you may not use this file except in compliance with the license",
    "A3": "you may obtain a copy of the license at",
    "G1": "this work is licensed under the gnu general public license version 3",
    "G2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "G3": "this program is distributed in the hope that it will be useful but without any warranty",
    "B1": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "B2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "C1": "licensed under cc by nc 4 0",
    "C2": "licensed under cc by 4 0",
    "C3": "licensed under cc by sa 4 0",
    "R1": "all rights reserved",
}
#: (license, kind, identifiers in order), the most specific first.
RULES = (
    ("MIT-full", "permissive", ("M2", "M3", "M4")),
    ("MIT-grant", "permissive", ("M2", "M3")),
    ("GPL-3.0-notice", "copyleft", ("G2", "G3")),
    ("BSD", "permissive", ("B1", "B2")),
    ("Apache-2.0-notice", "permissive", ("A1", "A2")),
    ("MIT", "permissive", ("M1",)),
    ("MIT-grant", "permissive", ("M2",)),
    ("Apache-2.0", "permissive", ("A1",)),
    ("GPL-3.0", "copyleft", ("G1",)),
    ("GPL-3.0-notice", "copyleft", ("G2",)),
    ("CC-BY-NC-4.0", "noncommercial", ("C1",)),
    ("CC-BY-4.0", "permissive", ("C2",)),
    ("CC-BY-SA-4.0", "copyleft", ("C3",)),
    ("proprietary", "reserved", ("R1",)),
)
#: Forms in which license texts have these sentences and others; (identifiers, form).
FORMS = (
    ("M3", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    ("A1", "licensed under the apache license version 2 0 the license"),
    ("A1 A2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("G3", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("G4", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("L1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("L2", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("P1", "this source code form is subject to the terms of the mozilla public license v"),  # a full stop follows
    ("I1", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("I1", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("U1", "this is free and unencumbered software released into the public domain"),
    ("B3", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("B4", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("B5", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("G5", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("Z1", "this software is provided as is without any express or implied warranty"),
    ("Z2", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("S1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("S2", "distributed under the boost software license version 1 0"),
    ("K1", "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
)
# Identifiers of tags of one line, and the kind of each license.
TAGS = {
    "MIT": "permissive", "Apache-2.0": "permissive", "BSD-2-Clause": "permissive", "BSD-3-Clause": "permissive", "ISC": "permissive", "Zlib": "permissive",
    "BSL-1.0": "permissive", "Unlicense": "permissive", "CC0-1.0": "permissive", "MPL-2.0": "copyleft", "EPL-2.0": "copyleft", "LGPL-2.1-only": "copyleft",
    "LGPL-2.1-or-later": "copyleft", "LGPL-3.0-only": "copyleft", "LGPL-3.0-or-later": "copyleft", "GPL-2.0-only": "copyleft", "GPL-2.0-or-later": "copyleft",
    "GPL-3.0-only": "copyleft", "GPL-3.0-or-later": "copyleft", "AGPL-3.0-only": "copyleft", "AGPL-3.0-or-later": "copyleft",
}
#: A tag's sentence identifier is "x" and a letter.
FORMS += tuple((f"x{chr(97 + k)}", "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower())) for k, name in enumerate(TAGS))
#: Rules that are more specific than RULES.
FIRST_RULES = (
    ("BSD-3-Clause", "permissive", ("B1", "B2", "B3", "B4")),
    ("BSD-2-Clause", "permissive", ("B1", "B2", "B3")),
)
#: The rules of the identifiers that only FORMS has.
MORE_RULES = (
    ("GPL-2.0-notice", "copyleft", ("G4", "G3")),
    ("GPL-2.0-notice", "copyleft", ("G4",)),
    ("LGPL-2.1-notice", "copyleft", ("L1",)),
    ("LGPL-3.0-notice", "copyleft", ("L2",)),
    ("MPL-2.0-notice", "copyleft", ("P1",)),
    ("ISC", "permissive", ("I1",)),
    ("Unlicense", "permissive", ("U1",)),
    ("AGPL-3.0-notice", "copyleft", ("G5", "G3")),
    ("AGPL-3.0-notice", "copyleft", ("G5",)),
    ("Zlib", "permissive", ("Z1", "Z2")),
    ("Zlib", "permissive", ("Z2",)),
    ("BSL-1.0", "permissive", ("S1",)),
    ("BSL-1.0", "permissive", ("S2",)),
    ("CC0-1.0", "permissive", ("K1",)),
    *((name, kind, (f"x{chr(97 + k)}",)) for k, (name, kind) in enumerate(TAGS.items())),
)
ID = 2  # characters of an identifier


def normalised(text: Column) -> Column:
    """Lower-case words, one space between them; ``\\n`` for an end of sentence or paragraph, ``\\r`` for one of a line."""
    one = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[.!?]+[ \t\r\n]+", "\x01")
    one = F.translate(F.regexp_replace(one, r"[^a-z0-9\n\x01]+", " "), "\n\x01", "\r\n")
    one = F.regexp_replace(one, r" ?([\r\n]) ?", "$1")
    return F.concat(F.lit("\n"), F.trim(F.regexp_replace(one, r"\r[\r\n]+|\n[\r\n]+", "\n")), F.lit("\n"))


def found(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order."""
    names = {v: k for k, v in SENTENCES.items()} | {v: k for k, v in FORMS}
    # the longest first, as one may begin like another
    either = "|".join(v.replace(" ", "[ \r]") for v in sorted(names, key=len, reverse=True))
    known = F.regexp_extract_all(normalised(text), F.lit(rf"(?<=[\r\n])(?:{either})(?=[\r\n])"), F.lit(0))
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform(known, lambda s: F.element_at(name, F.translate(s, "\r", " ")))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (in order), licenses (in the rules' order), kinds, n_sentences."""
    out = docs.select("doc_id", F.array_join(found(F.col("text")), " ").alias("sentence_ids"))
    left = F.concat(F.lit(" "), F.col("sentence_ids"), F.lit(" "))
    hits = []
    for name, kind, ids in FIRST_RULES + RULES + MORE_RULES:
        # each identifier has its own spaces, so neighbours both match
        out = out.withColumn("left", F.regexp_replace(left, " ", "  ")) if "left" not in out.columns else out
        seq = " " + "  ".join(ids) + " "
        hits.append((F.col("left").contains(seq), name, kind))
        flag = f"r{len(hits)}"
        out = out.withColumn(flag, hits[-1][0]).withColumn("left", F.replace(F.col("left"), F.lit(seq), F.lit(" ~ ")))
    pick = lambda k: F.array_distinct(F.array_compact(F.array(*[
        F.when(F.col(f"r{i}"), F.lit(h[k])) for i, h in enumerate(hits, 1)])))
    return out.select(
        "doc_id", "sentence_ids", F.array_join(pick(1), " ").alias("licenses"), F.array_join(F.array_sort(pick(2)), " ").alias("kinds"),
        F.expr(f"cast((length(sentence_ids) + 1) div {ID + 1} as bigint)").alias("n_sentences"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    # one-line notices of SENTENCES only, which is all that the given tables hold
    known = ", ".join(f"'{v}'" for v in SENTENCES.values())
    names = ", ".join(f"'{v}': '{k}'" for k, v in SENTENCES.items())
    steps, last = [], "l0"
    for i, (_, _, ids) in enumerate(RULES, 1):
        seq = " " + "  ".join(ids) + " "
        steps.append(f"l{i} as (select * exclude (w), contains(w, '{seq}') as r{i}, replace(w, '{seq}', ' ~ ') as w from {last})")
        last = f"l{i}"
    pick = lambda k: ", ".join(f"case when r{i} then '{r[k]}' end" for i, r in enumerate(RULES, 1))
    distinct = lambda x: f"list_filter({x}, lambda v, i: v is not null and list_position({x}, v) = i)"
    return f"""
with s as (
  select doc_id, list_transform(string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')),
      '[.!?]+[ \\t\\r\\n]+|\\n+', chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)), lambda x: trim(x)) as l
  from documents),
f as (select doc_id, list_transform(list_filter(l, lambda x: x in ({known})), lambda x: map {{{names}}}[x]) as ids from s),
j as (select doc_id, coalesce(list_aggregate(ids, 'string_agg', ' '), '') as sentence_ids from f),
l0 as (select *, '  ' || replace(sentence_ids, ' ', '  ') || '  ' as w from j),
{", ".join(steps)},
p as (select *, [{pick(0)}] as a, [{pick(1)}] as b from {last})
select doc_id, sentence_ids, array_to_string({distinct("a")}, ' ') as licenses,
       array_to_string(list_sort({distinct("b")}), ' ') as kinds,
       cast((length(sentence_ids) + 1) // {ID + 1} as bigint) as n_sentences
from p
"""


SQL = _sql()
