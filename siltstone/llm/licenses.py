"""License scans by sentence rules, in DataFrame functions only.

A text is normalised with its ends of sentences and lines marked, and known license sentences are found between two
marks, over wrapped lines too; the identifiers found, in
order, are matched against the ordered sequences of identifiers that make up each license.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public license texts and notices, normalised as ``normal`` does; the number is the identifier.
SENTENCES = (
    "licensed under the apache license version 2 0",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "see the license for the specific language governing permissions and limitations under the license",
    "released under the mit license",
    "licensed under the mit license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "this work is licensed under the gnu general public license version 3",
    "this work is licensed under the gnu general public license version 2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "see the gnu general public license for more details",
    "licensed under cc by nc 4 0",
    "licensed under cc by 4 0",
    "licensed under cc by sa 4 0",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "this source code form is subject to the terms of the mozilla public license v 2 0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "this is free and unencumbered software released into the public domain",
    "all rights reserved",
)

#: License, whether its terms allow commercial reuse, and its sentences (from 1) in order; a license may have several rules.
RULES = (
    ("Apache-2.0", True, (1,)),
    ("Apache-2.0", True, (1, 2, 3, 4, 5)),
    ("MIT", True, (6,)),
    ("MIT", True, (7,)),
    ("MIT", True, (8, 9, 10)),
    ("MIT", True, (8, 9)),
    ("GPL-3.0", True, (11,)),
    ("GPL-2.0", True, (12,)),
    ("GPL-3.0-or-later", True, (13, 15, 16)),
    ("GPL-2.0-or-later", True, (14, 15, 16)),
    ("CC-BY-NC-4.0", False, (17,)),
    ("CC-BY-4.0", True, (18,)),
    ("CC-BY-SA-4.0", True, (19,)),
    ("CC-BY-4.0", True, (20,)),
    ("CC-BY-NC-4.0", False, (21,)),
    ("CC-BY-SA-4.0", True, (22,)),
    ("BSD-2-Clause", True, (23, 24, 25)),
    ("BSD-3-Clause", True, (23, 24, 25, 26)),
    ("MPL-2.0", True, (27,)),
    ("ISC", True, (28,)),
    ("Unlicense", True, (29,)),
    ("proprietary", False, (30,)),
)

#: Other wordings of known sentences, as real notices have them, by the identifier they stand for.
WORDINGS = {
    "licensed under the apache license version 2 0 the license": 1,
    "this project is licensed under the mit license": 7,
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": 9,
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": 28,
}
#: The names that this sentence may hold.
_HELD = "neither the name of(?:[ \\x02][a-z0-9]+){1,12}?[ \\x02]nor"

#: In the SQL a sentence ends at a line end, or after . ! ? or ; with white space behind.
BREAK = r"\n+|(?<=[.!?;])[ \t\r]+"


def normal(sentence: Column) -> Column:
    """Lower case, every run of other characters than letters and digits as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _pattern() -> str:
    """Known sentences between two ends; lines and sentence marks may lie between their words, but no blank line."""
    said = sorted([*SENTENCES, *WORDINGS], key=len, reverse=True)
    plain = [x.replace(" ", "[ \\x02]") for x in said]
    held = [x.replace("neither[ \\x02]the[ \\x02]name[ \\x02]of[ \\x02]the[ \\x02]copyright[ \\x02]holder[ \\x02]nor", _HELD) for x in plain]
    return "(?<=[\\x01\\x02])(?:" + "|".join(held) + ")(?=[\\x01\\x02])"


def marked(text: Column) -> Column:
    """The text normalised, with \x01 for blank lines and list marks and \x02 for other line ends and sentence marks."""
    text = F.translate(F.lower(text), "\x01\x02", "  ")
    text = F.regexp_replace(text, r"\n[^a-z0-9\n]*\(?[0-9a-z]{1,2}[.)][ \t]+", "\n\n")
    text = F.regexp_replace(text, r"(?m)^[ \t]*(?:dnl|rem)\b", "")
    text = F.regexp_replace(text, r"\n[^a-z0-9\n]*\n", "\x01")
    text = F.regexp_replace(text, r"[.!?;:][ \t\r]|\n", "\x02")
    text = F.regexp_replace(text, r"[^a-z0-9\x01\x02]*\x01[^a-z0-9]*", "\x01")
    text = F.regexp_replace(text, r"[^a-z0-9\x01\x02]*\x02[^a-z0-9\x01]*", "\x02")
    text = F.regexp_replace(text, r"[^a-z0-9\x01\x02]+", " ")
    # White space beside a mark and at the ends goes.
    text = F.regexp_replace(F.concat(F.lit("\x01"), F.trim(text), F.lit("\x01")), r" *([\x01\x02]) *", "$1")
    return text


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in its order."""
    known = F.array(*(F.lit(s) for s in [*SENTENCES, *WORDINGS]))
    ids = F.array(*(F.lit(i).cast("long") for i in [*range(1, len(SENTENCES) + 1), *WORDINGS.values()]))
    found = F.regexp_extract_all(marked(F.coalesce(text, F.lit(""))), F.lit(_pattern()), F.lit(0))
    plain = F.transform(found, lambda s: F.regexp_replace(F.translate(s, "\x02", " "), "^neither the name of .* nor the names", "neither the name of the copyright holder nor the names"))
    # Few texts hold one of these words.
    held = F.coalesce(text, F.lit("")).rlike("(?i)licen|copyright|permi|redistribut|reserved|software|names|warrant")
    return F.when(held, F.transform(plain, lambda s: F.element_at(ids, F.array_position(known, s).cast("int")))).otherwise(F.array().cast("array<bigint>"))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, sentence_ids (string, comma-joined, in order), licenses (string: the names of matched rules, sorted,
    comma-joined), n_licenses (long), restricted (boolean: one of them forbids commercial reuse).

    A rule matches where its identifiers follow each other among the known sentences, unless that place lies inside the
    match of a longer rule.  Null and empty texts have no sentences; very long texts are read whole; repeated rows and null
    doc_ids stay; rules that tie are all told; other columns are dropped; an empty table gives an empty result.  No exchange and no code outside the JVM.
    """
    listed = F.array_join(F.transform(F.col("ids"), lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), "")
    code = lambda rule: "".join(f"<{i}>" for i in rule[2])
    longer = {r: sorted((x for x in RULES if len(x[2]) > len(r[2]) and code(r) in code(x)), key=lambda x: -len(x[2])) for r in RULES}

    def matched(rule) -> Column:
        here = F.col("listed")
        for x in longer[rule]:
            here = F.replace(here, F.lit(code(x)), F.lit("-"))
        return here.contains(code(rule))

    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(matched(r), F.lit(r[0])) for r in RULES)))))
    bound = F.lit(False)
    for r in RULES:
        if not r[1]:
            bound = bound | matched(r)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sentence_ids(F.col("text").cast("string")).alias("ids"))
    rows = rows.select("doc_id", "ids", listed.alias("listed"))
    return rows.select("doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("sentence_ids"), F.array_join(names, ",").alias("licenses"), F.size(names).cast("long").alias("n_licenses"), bound.alias("restricted"))
