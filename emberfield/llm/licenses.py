"""Licence scans by sentence rules, as column expressions: one narrow pass over the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, each with an identifier of its own.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Licensed under the MIT License."),
    ("mit-notice", "This project is licensed under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache2-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache2-notice", "This project is licensed under the Apache License, Version 2.0."),
    ("apache2-header", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("apache2-compliance", "you may not use this file except in compliance with the License."),
    ("gpl3-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl3-notice", "Licensed under the GNU General Public License, version 3."),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl2-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("any-later", "or (at your option) any later version."),
    ("lgpl3-notice", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl3-notice", "Licensed under the GNU Affero General Public License, version 3."),
    ("mpl2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0", "This work is dedicated to the public domain under CC0 1.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("all-rights", "All rights reserved."),
)

# Ordered rules: the first that matches takes its sentences; what is left goes to the rules after it.
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("MIT", "permissive", ("mit-grant", "mit-condition")),
    ("BSD-3-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", "permissive", ("apache2-header", "apache2-compliance")),
    ("GPL-3.0-or-later", "copyleft", ("gpl-header", "gpl-warranty")),
    ("GPL-2.0-or-later", "copyleft", ("gpl2-header", "gpl-warranty")),
    ("GPL-3.0-or-later", "copyleft", ("gpl3-notice", "any-later")),
    ("GPL-3.0-or-later", "copyleft", ("gpl-header",)),
    ("GPL-2.0-or-later", "copyleft", ("gpl2-header",)),
    ("GPL-3.0-only", "copyleft", ("gpl3-notice",)),
    ("LGPL-3.0-only", "copyleft", ("lgpl3-notice",)),
    ("AGPL-3.0-only", "copyleft", ("agpl3-notice",)),
    ("MPL-2.0", "copyleft", ("mpl2-notice",)),
    ("Apache-2.0", "permissive", ("apache2-notice",)),
    ("Apache-2.0", "permissive", ("apache2-header",)),
    ("MIT", "permissive", ("mit-notice",)),
    ("MIT", "permissive", ("mit-grant",)),
    ("ISC", "permissive", ("isc-grant",)),
    ("Unlicense", "public-domain", ("unlicense",)),
    ("CC0-1.0", "public-domain", ("cc0",)),
    ("CC-BY-NC-4.0", "restricted", ("cc-by-nc",)),
    ("CC-BY-ND-4.0", "restricted", ("cc-by-nd",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa",)),
    ("CC-BY-4.0", "permissive", ("cc-by",)),
    ("LicenseRef-All-Rights-Reserved", "restricted", ("all-rights",)),
)

# A rule that counts only where no other one matches: many grants carry its sentence too.
ALONE = "LicenseRef-All-Rights-Reserved"

# A sentence ends after .!?:; and white space, and at a line end unless the next line goes on in lower case.
BOUNDARY = r"(?<=[.!?:;])[ \t\r\n]+|\n(?![ \t]*[a-z])"
# Stands for a boundary between words.
MARK = "\x01"
# Any known sentence has one of these, with any white space and marks between words; other documents are done after one look.
HINT = r"(?i)licen[sc]e|permission|warranty|redistribut|public domain|rights reserved|free software|any later version".replace(" ", "[^0-9A-Za-z]+")


def normalised(sentence: str) -> str:
    """Lower case, anything but ASCII letters and digits one space."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence).lower().split())


def _pattern() -> str:
    """The known sentences over words held apart by one space or MARK, from boundary to boundary, longest first."""
    words = sorted({normalised(s) for _, s in SENTENCES}, key=lambda s: (-len(s), s))
    return f"(?<![^{MARK}])(?:{'|'.join(words).replace(' ', f'[ {MARK}]')})(?![^{MARK}])"


def recognised(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order.

    A known sentence begins and ends at boundaries. It may have others inside, such as its own colons and semicolons
    or line ends before a capital, a bracket or a comment mark; of sentences that begin alike the longest counts.
    """
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES for x in (normalised(s), i)])
    marked = F.regexp_replace(F.translate(text, MARK, "\x02"), BOUNDARY, MARK)
    words = F.lower(F.regexp_replace(F.regexp_replace(marked, f"[^0-9A-Za-z{MARK}]+", " "), f" ?{MARK}[ {MARK}]*", MARK))
    spans = F.regexp_extract_all(F.trim(words), F.lit(_pattern()), F.lit(0))
    found = F.transform(spans, lambda s: known[F.translate(s, MARK, " ")])
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses, license_class: one row per input row, without a shuffle.

    ``sentence_ids``: the known sentences in order, joined by commas; ``licenses``: those of the rules that match, in
    the order of the rules, each once (all rights reserved only where nothing else matches); ``license_class``: the strictest (restricted, copyleft, permissive,
    public-domain), or none. A rule matches identifiers that follow each other; unknown sentences between them don't
    count. Null and empty texts have no sentences. Repeated rows give repeated results; a null doc_id stays null.
    """
    ids = docs.select(F.col(doc_id).alias("doc_id"), recognised(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("ids"))
    ids = ids.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(",")).alias("left"))
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit("".join(f",{i}," for i in seq)).alias("seq")) for n, k, seq in RULES])
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<string>").alias("names"), F.array().cast("array<string>").alias("kinds"))

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["seq"]) & ((rule["name"] != ALONE) | (F.size(state["names"]) == 0))
        return F.struct(
            F.replace(state["left"], rule["seq"], F.lit("")).alias("left"),
            F.when(hit, F.array_append(state["names"], rule["name"])).otherwise(state["names"]).alias("names"),
            F.when(hit, F.array_append(state["kinds"], rule["kind"])).otherwise(state["kinds"]).alias("kinds"),
        )

    state = F.when(F.col("n_sentences") > 0, F.aggregate(rules, start, apply))
    out = ids.select("doc_id", "n_sentences", "sentence_ids", state.alias("s"))
    kinds = F.col("s.kinds")
    strictest = F.lit("none")
    for kind in ("public-domain", "permissive", "copyleft", "restricted"):
        strictest = F.when(F.array_contains(kinds, kind), kind).otherwise(strictest)
    return out.select("doc_id", "n_sentences", "sentence_ids", F.coalesce(F.array_join(F.array_distinct("s.names"), ","), F.lit("")).alias("licenses"), strictest.alias("license_class"))


def _sql() -> str:
    """SQL twin over the same marked words: boundaries are doubled marks, so that neighbours have one each to end with."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(normalised(s))}, {quoted(i)})" for i, s in SENTENCES)
    sentences = sorted({normalised(s) for _, s in SENTENCES}, key=lambda s: (-len(s), s))
    pattern = r"(?:^|\x01)(?:" + "|".join(sentences).replace(" ", r"(?: |\x01\x01)") + r")(?:\x01|$)"
    steps, last = [], "f0"
    for k, (name, kind, seq) in enumerate(RULES, 1):
        ids = quoted("".join(f",{i}," for i in seq))
        hit = f"contains(rest, {ids})" + (" AND len(names) = 0" if name == ALONE else "")
        steps.append(f"f{k} AS (SELECT doc_id, ids, replace(rest, {ids}, '') AS rest, CASE WHEN {hit} THEN list_append(names, {quoted(name)}) ELSE names END AS names, CASE WHEN {hit} THEN list_append(kinds, {quoted(kind)}) ELSE kinds END AS kinds FROM {last})")
        last = f"f{k}"
    return f"""
WITH known(sentence, id) AS (SELECT DISTINCT * FROM (VALUES {known}) v(sentence, id)),
t AS (SELECT doc_id, row_number() OVER () AS r, replace(regexp_replace(regexp_replace(replace(COALESCE(text, ''), chr(1), chr(2)), '([.!?:;])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), '\\n([ \\t]*[a-z])', ' \\1', 'g'), chr(10), chr(1)) AS marked FROM documents),
w AS (SELECT doc_id, r, trim(lower(regexp_replace(regexp_replace(marked, '[^0-9A-Za-z\\x01]+', ' ', 'g'), ' ?\\x01[ \\x01]*', chr(1) || chr(1), 'g'))) AS words FROM t),
s AS (SELECT r, unnest(regexp_extract_all(words, {quoted(pattern)})) AS found, generate_subscripts(regexp_extract_all(words, {quoted(pattern)}), 1) AS place FROM w),
m AS (SELECT s.r, list(k.id ORDER BY place) AS ids FROM s JOIN known k ON k.sentence = trim(regexp_replace(found, '[ \\x01]+', ' ', 'g')) GROUP BY s.r),
f0 AS (SELECT doc_id, COALESCE(ids, []) AS ids, ',' || array_to_string(COALESCE(ids, []), ',,') || ',' AS rest, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS kinds FROM t LEFT JOIN m ON t.r = m.r),
{", ".join(steps)},
d AS (SELECT *, list_filter(names, lambda x, i: list_position(names, x) = i) AS once FROM {last})
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(once, ',') AS licenses,
  CASE WHEN list_contains(kinds, 'restricted') THEN 'restricted' WHEN list_contains(kinds, 'copyleft') THEN 'copyleft'
       WHEN list_contains(kinds, 'permissive') THEN 'permissive' WHEN list_contains(kinds, 'public-domain') THEN 'public-domain' ELSE 'none' END AS license_class
FROM d
"""


LICENSES_SQL = _sql()
