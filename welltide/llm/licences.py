"""Licence recognition by sentences and ordered rules.

A text is cut into sentences at sentence ends and line breaks; normalised sentences that are known give an identifier, also those that single
line breaks (with or without comment marks) divide: of the sentences that begin at a cut the longest counts. A blank line always ends one. The identifiers in the text's order form a sequence;
rules, in their order, look for their identifiers side by side in it, and what a rule matched is not seen by later ones. Identifiers that no
rule used are reported as well. All steps are DataFrame functions inside a row, so nothing is shuffled.

Texts without any anchor word (every known sentence has one) are not cut.

Cases: null and empty texts have no licence; a sentence that occurs twice gives its identifier twice; repeated rows give repeated results;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from welltide.llm.common import table

# Sentences of public licences and licence notices, with the identifier of each.
SENTENCES = [
    ("mit_name", "The MIT License"),
    ("mit_name", "MIT License"),
    ("mit_notice", "Released under the MIT License"),
    ("mit_notice", "Licensed under the MIT License"),
    ("mit_grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit_keep", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit_as_is", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("isc_grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd_grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd_source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd_binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd_endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache_notice", "Licensed under the Apache License, Version 2.0"),
    ("apache_notice", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("apache_comply", "you may not use this file except in compliance with the License"),
    ("apache_copy", "You may obtain a copy of the License at"),
    ("apache_as_is", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl3_work", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl_terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl2_terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"),
    ("gpl_no_warranty", "See the GNU General Public License for more details"),
    ("lgpl_notice", "Licensed under the GNU Lesser General Public License, version 3"),
    ("cc_by_nc_4", "Licensed under CC BY-NC 4.0"),
    ("cc_by_4", "Licensed under CC BY 4.0"),
    ("cc_by_sa_4", "Licensed under CC BY-SA 4.0"),
    ("cc_by_4", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc_by_sa_4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc_by_nc_4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("public_domain", "This work has been dedicated to the public domain under the CC0 license"),
    ("mpl_terms", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]

# Licence and the sentences that show it, in order of precedence.
RULES = [
    ("MIT", ["mit_name", "mit_grant", "mit_keep", "mit_as_is"]),
    ("MIT", ["mit_grant", "mit_keep", "mit_as_is"]),
    ("MIT", ["mit_grant", "mit_keep"]),
    ("ISC", ["isc_grant"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("Apache-2.0", ["apache_notice", "apache_comply", "apache_copy", "apache_as_is"]),
    ("Apache-2.0", ["apache_notice", "apache_comply"]),
    ("GPL-3.0-or-later", ["gpl_terms", "gpl_no_warranty"]),
    ("GPL-3.0-or-later", ["gpl_terms"]),
    ("GPL-2.0-or-later", ["gpl2_terms", "gpl_no_warranty"]),
    ("GPL-2.0-or-later", ["gpl2_terms"]),
    ("MIT", ["mit_notice"]),
    ("Apache-2.0", ["apache_notice"]),
    ("GPL-3.0-only", ["gpl3_work"]),
    ("LGPL-3.0-only", ["lgpl_notice"]),
    ("MPL-2.0", ["mpl_terms"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_4"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_4"]),
    ("CC-BY-4.0", ["cc_by_4"]),
    ("CC0-1.0", ["public_domain"]),
]

ANCHORS = ["licen", "permission", "copyright", "warrant", "permitted", "general public"]

_CUT, _OTHER = r"[.!?;:]\s+|\n", r"[^a-z0-9]+"


def normal(sentence: str) -> str:
    return re.sub(_OTHER, " ", sentence.lower()).strip()


#: Normalised sentence to identifier. A sentence that the cut divides could never be found whole.
KNOWN = {normal(s): name for name, s in SENTENCES}
if any(not any(a in s for a in ANCHORS) for s in KNOWN) or any(re.search(_CUT, re.sub(r" v\. ", " v ", s)) for _, s in SENTENCES):
    raise ValueError("a known sentence has no anchor word or is cut")
# The abbreviation's full stop cuts this sentence in texts; its second half has no meaning of its own.
KNOWN[normal("This Source Code Form is subject to the terms of the Mozilla Public License, v")] = "mpl_terms"


def _pattern() -> str:
    """Known sentences between cuts, longest first. In the text an S is a sentence end or blank line, an L a line break; words are in lower case."""
    known = sorted(KNOWN, key=lambda k: (-len(k), k))
    return "(?:^|(?<=[SL])) ?(" + "|".join(k.replace(" ", "(?: ?L ?| )") for k in known) + ")(?= ?(?:[SL]|$))"


def identifiers(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order."""
    t = F.lower(F.coalesce(text, F.lit("")))
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[.!?;:]\s+", "S"), r"\n", "L"), "[^a-z0-9SL]+", " ")
    found = F.regexp_extract_all(F.regexp_replace(marked, "L(?: ?L)+", "S"), F.lit(_pattern()), F.lit(1))
    names = F.transform(found, lambda s: F.try_element_at(known, F.regexp_replace(s, " ?L ?", " ")))
    some = reduce(lambda a, b: a | b, [F.contains(t, F.lit(a)) for a in ANCHORS])
    return F.when(some, F.array_compact(names)).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, identifiers, licences (arrays, in order of the rules), unused (identifiers that no rule matched) of every row."""
    own = docs.select(F.col(key).alias("key"), identifiers(F.col(text)).alias("ids"))
    wrapped = F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit("["), i, F.lit("]"))))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"[{i}]" for i in ids)).alias("ids")) for name, ids in RULES])
    start = F.struct(wrapped.alias("rest"), F.array().cast("array<string>").alias("hits"))

    def step(s: Column, r: Column) -> Column:
        hit = F.contains(s["rest"], r["ids"])
        return F.struct(F.when(hit, F.replace(s["rest"], r["ids"], F.lit("*"))).otherwise(s["rest"]).alias("rest"),
                        F.when(hit, F.concat(s["hits"], F.array(r["name"]))).otherwise(s["hits"]).alias("hits"))

    done = own.withColumn("r", F.when(F.size("ids") > 0, F.aggregate(rules, start, step)))
    none = F.array().cast("array<string>")
    left = F.filter(F.split(F.replace(F.replace(F.col("r.rest"), F.lit("*"), F.lit("")), F.lit("["), F.lit("")), "]"), lambda x: x != "")
    return done.select(F.col("key").alias(key), F.col("ids").alias("identifiers"), F.coalesce(F.array_distinct(F.col("r.hits")), none).alias("licences"), F.coalesce(left, none).alias("unused"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every whole text of ``documents``; the arrays as text."""
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("identifiers", "licences", "unused")])


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(s)}, {q(n)})" for s, n in KNOWN.items())
    some = " OR ".join(f"contains(lower(text), {q(a)})" for a in ANCHORS)
    step = "SELECT doc_id, ids, array_to_string(list_transform(ids, lambda i: '[' || i || ']'), '') AS rest, '' AS hits FROM named"
    for name, ids in RULES:
        mark = q("".join(f"[{i}]" for i in ids))
        step = f"SELECT doc_id, ids, replace(rest, {mark}, '*') AS rest, CASE WHEN contains(rest, {mark}) AND NOT contains(hits || ',', ',{name},') THEN hits || ',{name}' ELSE hits END AS hits FROM ({step})"
    return rf"""
WITH k AS (SELECT * FROM (VALUES {known}) AS v(s, name)),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
cut AS (SELECT r, unnest(parts) AS part, unnest(range(len(parts))) AS i
        FROM (SELECT r, string_split_regex(lower(text), '{_CUT}') AS parts FROM d WHERE {some})),
found AS (SELECT r, list(name ORDER BY i) AS ids FROM cut JOIN k ON k.s = trim(regexp_replace(part, '{_OTHER}', ' ', 'g')) GROUP BY r),
named AS (SELECT doc_id, coalesce(ids, []::VARCHAR[]) AS ids FROM d LEFT JOIN found USING (r))
SELECT doc_id, array_to_string(ids, ',') AS identifiers, ltrim(hits, ',') AS licences,
       array_to_string(list_filter(string_split(replace(replace(rest, '*', ''), '[', ''), ']'), lambda x: x <> ''), ',') AS unused
FROM ({step})
"""


OP9_SQL = _sql()
