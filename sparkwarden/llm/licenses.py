"""Licence statements by sentence rules.

Everything is DataFrame functions on one row at a time; nothing is shuffled. A text is
split into sentences, each is normalised (lower case, other characters than letters,
digits and ``+`` become single spaces) and looked up in the table of known licence
sentences. What a document holds is then a sequence of sentence numbers, with 0 for any
other sentence, and a licence is found where the numbers of one of its ordered rules
stand in a row, unknown sentences not counted up to ``GAP`` in a row between them.

Only texts with one of the ``ANCHORS`` are split; every known sentence has one.

Given results: null, empty and statement-free texts have no licences (empty lists).
Rules of several sentences win over the shorter rules they contain; what is found
repeatedly is counted, and listed once. The first BSD condition alone does not tell its
variant and is named BSD; the four-clause BSD text is not known. Every row gives one row, repeated rows too;
empty tables give none. Extra columns are ignored.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 2

# Sentences of public licence texts and notices, in normal form.
SENTENCES = (
    "licensed under the apache license version 2 0",
    "licensed under the apache license version 2 0 the license",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at",
    "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "unless required by applicable law or agreed to in writing software distributed under the "
    "license is distributed on an as is basis without warranties or conditions of any kind "
    "either express or implied",
    "see the license for the specific language governing permissions and limitations under the license",
    "released under the mit license",
    "licensed under the mit license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software "
    "and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute "
    "sublicense and or sell copies of the software and to permit persons to whom the software is "
    "furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the software",
    "the software is provided as is without warranty of any kind express or implied including but "
    "not limited to the warranties of merchantability fitness for a particular purpose and "
    "noninfringement",
    "in no event shall the authors or copyright holders be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in "
    "connection with the software or the use or other dealings in the software",
    "this work is licensed under the gnu general public license version 3",
    "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu general public license as published by the free software foundation either version 2 of "
    "the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu general public license as published by the free software foundation either version 3 of "
    "the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty "
    "without even the implied warranty of merchantability or fitness for a particular purpose",
    "see the gnu general public license for more details",
    "licensed under cc by nc 4 0",
    "licensed under cc by 4 0",
    "licensed under cc by sa 4 0",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions "
    "and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of "
    "conditions and the following disclaimer in the documentation and or other materials provided "
    "with the distribution",
    "this source code form is subject to the terms of the mozilla public license v 2 0",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "this is free and unencumbered software released into the public domain",
    "spdx license identifier apache 2 0",
    "spdx license identifier mit",
    "spdx license identifier gpl 3 0 or later",
    "spdx license identifier bsd 3 clause",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission",
    "the name of the author may not be used to endorse or promote products derived from this "
    "software without specific prior written permission",
    "licensed under the gnu general public license version 3",
    "licensed under a creative commons attribution 4 0 international license",
    "licensed under a creative commons attribution sharealike 4 0 international license",
    "licensed under a creative commons attribution noncommercial 4 0 international license",
)
# Licence names and the sentence numbers (from 1) that make each, in order.
RULES = (
    ("Apache-2.0", (2, 3, 4, 6, 7)),
    ("Apache-2.0", (2, 3, 5, 6, 7)),
    ("MIT", (10, 11, 12, 13)),
    ("GPL-2.0-or-later", (15, 17, 18)),
    ("GPL-3.0-or-later", (16, 17, 18)),
    ("BSD-3-Clause", (25, 26, 27, 35)),
    ("BSD-3-Clause", (25, 26, 27, 36)),
    ("BSD-2-Clause", (25, 26, 27)),
    ("MPL-2.0", (28, 29)),
    ("Apache-2.0", (1,)),
    ("Apache-2.0", (2,)),
    ("MIT", (8,)),
    ("MIT", (9,)),
    ("MIT", (10,)),
    ("GPL-3.0", (14,)),
    ("GPL-2.0-or-later", (15,)),
    ("GPL-3.0-or-later", (16,)),
    ("CC-BY-NC-4.0", (19,)),
    ("CC-BY-4.0", (20,)),
    ("CC-BY-SA-4.0", (21,)),
    ("CC-BY-4.0", (22,)),
    ("CC-BY-SA-4.0", (23,)),
    ("CC-BY-NC-4.0", (24,)),
    ("BSD", (25,)),
    ("MPL-2.0", (28,)),
    ("Unlicense", (30,)),
    ("Apache-2.0", (31,)),
    ("MIT", (32,)),
    ("GPL-3.0-or-later", (33,)),
    ("BSD-3-Clause", (34,)),
    ("GPL-3.0", (37,)),
    ("CC-BY-4.0", (38,)),
    ("CC-BY-SA-4.0", (39,)),
    ("CC-BY-NC-4.0", (40,)),
)
# Every known sentence holds one of these.
ANCHORS = ("licens", "permission", "copyright", "without warranty", "without any warranty", "redistribut", "mpl", "public domain")

_OTHER = r"[^a-z0-9+]+"
_ANCHOR = "(?i)" + "|".join(ANCHORS)
# (pattern, replacement) in order: comment marks, indentation and carriage returns go, marks
# that do not end a sentence inside a known notice go, a licence wrapped over lines is joined
# again, lead-ins are put in one form, and a full stop or colon ends a sentence where white
# space follows (not in 2.0).
UNWRAP = (
    (r"\r\n?", "\n"),
    (r"[ \t]+|[*#=~_/-]{4,}", " "),
    (r" ?(?:\*+/?|#+|//+|-->)? ?\n", "\n"),
    # a comment that ends is not continued by the code below it
    (r"((?:^|\n) ?(?:#|//)[^\n]*)\n([A-Za-z])", "$1\n\n$2"),
    (r"(^|\n) ?(?:(?:/\*+|\*+/?|//+!?|#+|--+|%+|;+|<!--+|dnl |REM |> ) ?)?", "$1"),
    (r"(SPDX-License-Identifier): ?([^\n]*)", "$1 $2\n"),
    (r"(MIT [Ll]icense|International [Ll]icense)\n", "$1\n\n"),
    # wraps before a capital, a digit, a quote or a bracket
    (r"([^A-Za-z](?:[Tt]he|[Tt]his|of|or|OR|and|under|an?|in|by|to|IN|THE|OF|FOR|A|AND|NO))\n([\"“(]*[A-Za-z0-9])", "$1 $2"),
    (
        r"(GNU|General|Public|Free|Creative|Commons|Mozilla|Source|Code|MIT|Apache|International)\n"
        r"(General|Public|[Ll]icense|Software|Foundation|Commons|Attribution|Code|Form)",
        "$1 $2",
    ),
    (r"(Software)\n(Foundation)", "$1 $2"),
    (r"(Licen[cs]e,|Attribution-?)\n(Version|ShareAlike|NonCommercial|[Oo]r )", "$1 $2"),
    (r"([Vv]ersion|ShareAlike|NonCommercial|Attribution|CC BY|CC BY-NC|CC BY-SA)\n([0-9])", "$1 $2"),
    (r"([0-9])\n(International|\([Tt]he|\(at your|of the )", "$1 $2"),
    (r"([a-z,])\n(\(at your|\([Tt]he|\"|“|You can obtain)", "$1 $2"),
    (r"([\"”)])\n([a-z]|BASIS|WITHOUT)", "$1 $2"),
    (r"([A-Za-z,])\n([a-z])", "$1 $2"),
    (r"([A-Z,])\n([A-Z][A-Z])", "$1 $2"),
    (r"([Ss]oftware|[Ff]oundation|WARRANTY|[Ww]arranty)[;:][ \n]+([Yy]ou can|either version|without even)", "$1 $2"),
    (r"([ (,]v)\.[ \n]+([0-9])", "$1 $2"),
    (r"https://", "http://"),
    (r"[Nn]either the names? of [^;!?\n]{1,200}? nor the names of (?:its|their|any) ", "Neither the name of the copyright holder nor the names of its "),
    (
        r"[Tt]his (?:project|file|software|program|library|package|module|code|repository|document|source code|documentation) is "
        r"(?:licensed|released|distributed|available|provided) under (?:the terms of )?",
        "licensed under ",
    ),
    (r"[.:]([ \t\r\n])", "\n$1"),
)
BREAK = r"[;!?\n]"


def normal(sentence: str) -> str:
    return re.sub(_OTHER, " ", sentence.lower()).strip()


def rule_pattern() -> str:
    """One alternation over all rules, longest first, on text such as ``<2><0><3>``."""
    unknown = rf"(?:<0>){{0,{GAP}}}"
    return "|".join(unknown.join(f"<{n}>" for n in numbers) for _, numbers in RULES)


def _numbers(text: Column) -> Column:
    known = F.create_map(*chain.from_iterable((F.lit(s), F.lit(i)) for i, s in enumerate(SENTENCES, 1)))
    for pattern, replacement in UNWRAP:
        text = F.regexp_replace(text, pattern, replacement)
    number = lambda s: F.coalesce(
        F.element_at(known, F.trim(F.regexp_replace(F.lower(s), _OTHER, " "))), F.lit(0)
    )
    return F.transform(F.filter(F.split(text, BREAK), lambda s: s.rlike("[A-Za-z0-9]")), number)


def rule_names() -> dict[str, str]:
    return {"".join(f"<{n}>" for n in numbers): name for name, numbers in RULES}


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids (comma-joined, in order), n_found
    and licenses (sorted names, comma-joined) for every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<int>")
    rows = docs.select(
        F.col("doc_id").cast("long"), F.when(text.rlike(_ANCHOR), _numbers(text)).otherwise(none).alias("numbers")
    )
    known = F.filter("numbers", lambda n: n > 0)
    line = F.array_join(F.transform("numbers", lambda n: F.concat(F.lit("<"), n.cast("string"), F.lit(">"))), "")
    found = F.regexp_extract_all(F.col("line"), F.lit(rule_pattern()), 0)
    names = F.create_map(*chain.from_iterable((F.lit(rule), F.lit(name)) for rule, name in rule_names().items()))
    told = F.transform("found", lambda m: F.element_at(names, F.replace(m, F.lit("<0>"), F.lit(""))))
    return (
        rows.withColumn("line", line)
        .withColumn("found", found)
        .select(
            "doc_id",
            F.size(known).cast("long").alias("n_sentences"),
            F.array_join(F.transform(known, lambda n: n.cast("string")), ",").alias("sentence_ids"),
            F.size("found").cast("long").alias("n_found"),
            F.array_join(F.array_sort(F.array_distinct(told)), ",").alias("licenses"),
        )
    )


def licenses_sql(table: str = "documents") -> str:
    """The same rows in DuckDB SQL, without the anchors."""

    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def mapped(entries: dict) -> str:
        values = ", ".join(v if isinstance(v, str) else str(v) for v in entries.values())
        return f"map([{', '.join(quoted(k) for k in entries)}], [{values}])"

    text = "coalesce(text, '')"
    for pattern, replacement in UNWRAP:
        new = quoted(replacement.replace("$", "\\")).replace("\n", "' || chr(10) || '")
        text = f"regexp_replace({text}, {quoted(pattern)}, {new}, 'g')"
    sentences = mapped({s: i for i, s in enumerate(SENTENCES, 1)})
    names = mapped({rule: quoted(name) for rule, name in rule_names().items()})
    return f"""
WITH known AS (SELECT {sentences} AS numbers, {names} AS names),
said AS (
  SELECT cast(doc_id AS bigint) AS doc_id, list_filter(
    string_split_regex({text}, {quoted(BREAK)}), lambda s: regexp_matches(s, '[A-Za-z0-9]')) AS sentences
  FROM {table}),
numbered AS (
  SELECT doc_id, names, list_transform(sentences, lambda s: coalesce(
    numbers[trim(regexp_replace(lower(s), {quoted(_OTHER)}, ' ', 'g'))], 0)) AS numbers
  FROM said, known),
matched AS (
  SELECT *, list_filter(numbers, lambda n: n > 0) AS own, regexp_extract_all(
    coalesce(array_to_string(list_transform(numbers, lambda n: '<' || n || '>'), ''), ''),
    {quoted(rule_pattern())}) AS found
  FROM numbered)
SELECT doc_id, cast(len(own) AS bigint) AS n_sentences,
  coalesce(array_to_string(own, ','), '') AS sentence_ids,
  cast(len(found) AS bigint) AS n_found,
  coalesce(array_to_string(list_sort(list_distinct(
    list_transform(found, lambda m: names[replace(m, '<0>', '')]))), ','), '') AS licenses
FROM matched"""
