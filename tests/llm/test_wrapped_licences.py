"""Licence texts as they are usually wrapped, with and without comment marks."""

import textwrap

from welltide.llm import licences

FIRST = {}
for name, sentence in licences.SENTENCES:
    FIRST.setdefault(name, sentence)


def wrapped(*parts, mark="", width=60):
    return "\n".join(mark + line for p in parts for line in [*textwrap.wrap(p, width), ""])


def test_wrapped_texts_are_found(spark):
    f = FIRST
    mit = [f["mit_name"], "Copyright (c) 2024 A", f["mit_grant"] + ":", f["mit_keep"] + ".", f["mit_as_is"] + ". IN NO EVENT SHALL THE AUTHORS BE LIABLE."]
    apache = [f["apache_notice"] + ' (the "License"); ' + f["apache_comply"] + ". " + f["apache_copy"], "    http://www.apache.org/licenses/LICENSE-2.0", f["apache_as_is"] + "."]
    bsd = [f["bsd_grant"] + ":", "1. " + f["bsd_source"] + ".", "2. " + f["bsd_binary"] + ".", "3. " + f["bsd_endorse"] + "."]
    gpl = ["This program is free software: " + f["gpl_terms"] + ".", "It is distributed in the hope that it will be useful. " + f["gpl_no_warranty"] + "."]
    texts = []
    for parts in (mit, apache, bsd, [f["isc_grant"] + "."], gpl):
        texts += [wrapped(*parts), wrapped(*parts, mark="// "), wrapped(*parts, mark=" * ").replace("\n", "\r\n")]
    texts += [f["mit_name"] + "\n" + f["mit_grant"] + ":\n" + f["mit_keep"] + ".", "Licensed under the\n\nMIT License", "Licensed under the\nMIT License, or not", "see licensed under the\nMIT License"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [list(r.licences) for r in licences.scan(df).orderBy("doc_id").collect()]
    want = [x for x in (["MIT"], ["Apache-2.0"], ["BSD-3-Clause"], ["ISC"], ["GPL-3.0-or-later"]) for _ in range(3)]
    assert got == [*want, ["MIT"], [], [], []]
    ids = [list(r.identifiers) for r in licences.scan(df).orderBy("doc_id").collect()]
    assert ids[0] == ["mit_name", "mit_grant", "mit_keep", "mit_as_is"] and ids[-3:] == [["mit_name"], [], ["mit_name"]]
