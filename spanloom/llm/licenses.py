"""License scans: normalised sentences become identifiers, identifier sequences become licences.

Only SQL expressions, evaluated row by row where the text is read: no shuffle, no Python. A text
is read twice: line by line, as one-line notices stand, and by paragraphs, with comment leaders
taken off and wrapped lines joined, as licence files and headers stand. A text
without any of the trigger words is passed over; its result is no licence, as no known sentence
lacks them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends of sentences: in the reading by lines, and in that by paragraphs.
LINE_END = r"[.!?;]+(?:[ \t\r\n]+|\z)|[\r\n]+"
PARAGRAPH_END = r"[.!?;:]+(?:[ \t\r\n]+|\z)|\n[ \t\r]*\n[ \t\r\n]*"
#: What marks a comment at the start of a line.
LEADER = r"(^|\n)[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|%+|<!--+|>+)[ \t]*"
#: What opens a sentence even without an end before it, as where a licence stands on one line.
OPENING = r"[ \t\r\n]+(Permission to use|Permission is hereby granted|Permission is granted|Unless required by applicable law|Licensed under the|Redistribution and use in source)"
TRIGGER = r"(?i)licen[cs]|permission|mpl was not|warrant|redistribut|liab|copyright|domain|reserved|endorse|advertising"
#: Repeats are possessive, so that no length of tag is matched by recursion.
SPDX = r"SPDX-License-Identifier:[ \t]*[(]*([A-Za-z0-9.+-]++(?:[ \t()]++(?:OR|AND|WITH)[ \t()]++[A-Za-z0-9.+-]++)*+)"
SPDX_WORD = r"[ \t()]+(?:OR|AND|WITH)[ \t()]+"
# Sentences of which a part differs from text to text, normalised as below, and their identifiers.
PATTERNS = {
    r"^neither the names? of .* may be used to endorse or promote products derived from this software without specific prior written permission$": "bsd_names",
    r"^the names? of .* may not be used to endorse or promote products derived from this software without specific prior written permission$": "bsd_names",
    r"^all advertising materials mentioning features or use of this software must display the following acknowledge?ment": "bsd_advert",
    r"^redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    r"^apache license version 2 0 january 2004": "apache2_title",
    r"^(?:the asf|the apache software foundation) licenses this file to you under the apache license version 2 0": "apache2_asf",
    r"^gnu general public license version 3 29 june 2007": "gpl3_title",
    r"^gnu general public license version 2 june 1991": "gpl2_title",
    r"^gnu lesser general public license version 3 29 june 2007": "lgpl3_title",
    r"^gnu lesser general public license version 2 1 february 1999": "lgpl21_title",
    r"^gnu affero general public license version 3 19 november 2007": "agpl3_title",
    r"under the terms of (?:the )?gnu general public license version 2 (?:only )?as published by the free software foundation$": "gpl2_only",
    r"under the terms of (?:the )?gnu general public license version 3 (?:only )?as published by the free software foundation$": "gpl3_only",
    r"^everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed$": "wtfpl_grant",
    r"^(?:this work is )?licensed under (?:a )?(?:cc by 3 0|creative commons attribution 3 0)": "ccby3_ref",
}
#: What a sentence of `PATTERNS` holds at least.
PATTERN_WORDS = r"licen[cs]e|endorse|advertising|redistributions"

# Normalised sentences (lower case, anything but a-z and 0-9 one space) and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2_ref",
    "licensed under the apache license version 2 0 the license": "apache2_ref",
    "you may not use this file except in compliance with the license": "apache2_use",
    "you may obtain a copy of the license at": "apache2_copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2_asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2_see",
    "released under the mit license": "mit_ref",
    "licensed under the mit license": "mit_ref",
    "this project is licensed under the mit license": "mit_ref",
    "licensed under mit": "mit_ref",
    "mit license": "mit_title",
    "the mit license": "mit_title",
    "the mit license mit": "mit_title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_asis",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit_liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "bsd0_grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc_asis",
    "licensed under the isc license": "isc_ref",
    "this work is licensed under the gnu general public license version 3": "gpl3_ref",
    "licensed under the gnu general public license version 3": "gpl3_ref",
    "this work is licensed under the gnu general public license version 2": "gpl2_ref",
    "licensed under the gnu general public license version 2": "gpl2_ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_grant",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_grant",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl_grant",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3_grant",
    "licensed under the gnu affero general public license version 3": "agpl3_ref",
    "licensed under the gnu lesser general public license version 3": "lgpl3_ref",
    "licensed under the gnu lesser general public license version 2 1": "lgpl21_ref",
    "either version 3 of the license or at your option any later version": "gpl3_later",
    "either version 2 of the license or at your option any later version": "gpl2_later",
    "either version 2 1 of the license or at your option any later version": "lgpl21_later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl_grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl_grant",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl_hope",
    "this library is distributed in the hope that it will be useful but without any warranty": "gpl_hope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_implied",
    "see the gnu general public license for more details": "gpl_see",
    "see the gnu lesser general public license for more details": "lgpl_see",
    "see the gnu affero general public license for more details": "agpl_see",
    "licensed under cc by nc 4 0": "ccbync4_ref",
    "licensed under cc by 4 0": "ccby4_ref",
    "licensed under cc by sa 4 0": "ccbysa4_ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4_ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4_ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4_ref",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0_grant",
    "you should have received a copy of the cc0 public domain dedication along with this software": "cc0_copy",
    "licensed under cc0 1 0": "cc0_ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd_asis",
    "this is free and unencumbered software released into the public domain": "unlicense_grant",
    "released into the public domain": "public_domain",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2_ref",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2_form",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2_obtain",
    "licensed under the mozilla public license version 2 0": "mpl2_ref",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2_ref",
    "licensed under the eclipse public license version 2 0": "epl2_ref",
    "this software is provided as is without any express or implied warranty": "zlib_asis",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib_liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "distributed under the boost software license version 1 0": "bsl1_ref",
    "boost software license version 1 0 august 17th 2003": "bsl1_title",
    "all rights reserved": "all_rights",
}
#: Ordered rules: every identifier in turn, with sentences of the same text allowed between. The
#: first rule of a family that matches stands; a later rule of that family isn't tried.
RULES = (
    ("MIT", "MIT", ("mit_grant", "mit_notice", "mit_asis")),
    ("MIT", "MIT", ("mit_notice", "mit_asis", "mit_liability")),
    ("MIT", "MIT", ("mit_ref",)),
    ("MIT", "MIT", ("mit_title", "mit_grant")),
    ("ISC", "ISC", ("isc_grant", "isc_asis")),
    ("ISC", "ISC", ("isc_ref",)),
    ("ISC", "0BSD", ("bsd0_grant", "isc_asis")),
    ("Apache", "Apache-2.0", ("apache2_ref", "apache2_use", "apache2_copy")),
    ("Apache", "Apache-2.0", ("apache2_ref",)),
    ("Apache", "Apache-2.0", ("apache2_use", "apache2_copy", "apache2_asis", "apache2_see")),
    ("Apache", "Apache-2.0", ("apache2_asf",)),
    ("Apache", "Apache-2.0", ("apache2_title",)),
    ("AGPL", "AGPL-3.0-or-later", ("agpl3_grant",)),
    ("AGPL", "AGPL-3.0", ("agpl3_ref",)),
    ("AGPL", "AGPL-3.0", ("agpl3_title",)),
    ("LGPL", "LGPL-2.1-or-later", ("lgpl_grant", "lgpl21_later")),
    ("LGPL", "LGPL-3.0-or-later", ("lgpl3_grant",)),
    ("LGPL", "LGPL-3.0", ("lgpl3_ref",)),
    ("LGPL", "LGPL-2.1", ("lgpl21_ref",)),
    ("LGPL", "LGPL-3.0", ("lgpl3_title",)),
    ("LGPL", "LGPL-2.1", ("lgpl21_title",)),
    ("GPL", "GPL-3.0-or-later", ("gpl_grant", "gpl3_later", "gpl_hope")),
    ("GPL", "GPL-3.0-or-later", ("gpl3_grant",)),
    ("GPL", "GPL-2.0-or-later", ("gpl_grant", "gpl2_later", "gpl_hope")),
    ("GPL", "GPL-2.0-or-later", ("gpl2_grant",)),
    ("GPL", "GPL-2.0-only", ("gpl2_only",)),
    ("GPL", "GPL-3.0-only", ("gpl3_only",)),
    ("GPL", "GPL-3.0", ("gpl3_ref",)),
    ("GPL", "GPL-2.0", ("gpl2_ref",)),
    ("GPL", "GPL-3.0", ("gpl3_title",)),
    ("GPL", "GPL-2.0", ("gpl2_title",)),
    ("CC0", "CC0-1.0", ("cc0_grant",)),
    ("CC0", "CC0-1.0", ("cc0_ref",)),
    ("CC", "CC-BY-NC-4.0", ("ccbync4_ref",)),
    ("CC", "CC-BY-SA-4.0", ("ccbysa4_ref",)),
    ("CC", "CC-BY-4.0", ("ccby4_ref",)),
    ("CC", "CC-BY-3.0", ("ccby3_ref",)),
    ("WTFPL", "WTFPL", ("wtfpl_grant",)),
    ("BSD", "BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advert")),
    ("BSD", "BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD", "BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("Unlicense", "Unlicense", ("unlicense_grant",)),
    ("Unlicense", "LicenseRef-Public-Domain", ("public_domain",)),
    ("MPL", "MPL-2.0", ("mpl2_ref",)),
    ("MPL", "MPL-2.0", ("mpl2_form", "mpl2_obtain")),
    ("EPL", "EPL-2.0", ("epl2_ref",)),
    ("Zlib", "Zlib", ("zlib_asis", "zlib_liability", "zlib_grant")),
    ("BSL", "BSL-1.0", ("bsl1_ref",)),
    ("BSL", "BSL-1.0", ("bsl1_title",)),
)


def rule_pattern(sequence: tuple[str, ...]) -> str:
    """A pattern over identifiers with a comma before and after each; a semicolon parts the two readings."""
    return "(?:[^;]*,)?".join(f",{i}," if not k else f"{i}," for k, i in enumerate(sequence))


def normalised(sentence: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(sentence, "[^A-Za-z0-9]+", " ")))


def known_sentences(text: Column, end: str) -> Column:
    """(at, id) of the known sentences of a text, in order, each with its number in the text (from 0)."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    sentences = F.filter(F.transform(F.split(text, end, -1), normalised), lambda s: s != "")

    def named(s: Column) -> Column:
        other = F.lit(None).cast("string")
        for pattern, ident in reversed(PATTERNS.items()):
            other = F.when(s.rlike(pattern), ident).otherwise(other)
        return F.coalesce(F.try_element_at(known, s), F.when(s.rlike(PATTERN_WORDS), other))

    return F.filter(
        F.transform(sentences, lambda s, i: F.struct(i.alias("at"), F.when(s.rlike(TRIGGER), named(s)).alias("id"))),
        lambda x: x["id"].isNotNull())


def matched_rules(ids: Column) -> Column:
    """Licences whose rule matches a sequence of identifiers in one of the readings."""
    families: dict[str, Column] = {}
    for family, licence, sequence in RULES:
        hit = ids.rlike(rule_pattern(sequence))
        families[family] = F.when(hit, licence) if family not in families else families[family].when(hit, licence)
    return F.array_compact(F.array(*families.values()))


def declared(text: Column) -> Column:
    """Licences that SPDX tags name."""
    names = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), lambda x: F.split(x, SPDX_WORD)))
    return F.filter(F.transform(names, lambda x: F.regexp_replace(x, r"[.]+\z", "")), lambda x: x != "")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_known, sentences, licences) for every row of `docs` (doc_id, text).

    `sentences` lists number:identifier of the known sentences in order, as the reading sees them that
    knows more of them, that by lines on a tie; `licences` the licences recognised in
    either reading or named by an SPDX tag, sorted; both are comma-joined and empty if there are none. Null and empty texts
    have none; a very long text is one row of its task; repeated rows give repeated results; other columns aren't read; an empty table
    gives no rows.
    """
    text, none = F.col("text"), F.array().cast("array<struct<at:int,id:string>>")
    wanted = text.rlike(TRIGGER)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.when(wanted, known_sentences(text, LINE_END)).otherwise(none).alias("by_line"),
        F.when(wanted, known_sentences(F.regexp_replace(F.regexp_replace(text, LEADER, "$1"), OPENING, "; $1"), PARAGRAPH_END)).otherwise(none).alias("by_paragraph"),
        F.when(wanted, declared(text)).otherwise(F.array().cast("array<string>")).alias("declared"))

    def ids(column: str) -> Column:
        return F.concat(F.lit(","), F.array_join(F.transform(column, lambda x: x["id"]), ","), F.lit(","))

    found = F.when(F.size("by_paragraph") > F.size("by_line"), F.col("by_paragraph")).otherwise(F.col("by_line"))
    licences = F.array_union(matched_rules(F.concat(ids("by_line"), F.lit(";"), ids("by_paragraph"))), F.col("declared"))
    return rows.select(
        "doc_id", F.size(found).cast("long").alias("n_known"),
        F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["at"], x["id"])), ",").alias("sentences"),
        F.array_join(F.sort_array(licences), ",").alias("licences"))


def scan_sql() -> str:
    """DuckDB SQL for `scan` over documents; its dialect knows no possessive repeats."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = f"map([{', '.join(map(quoted, SENTENCES))}], [{', '.join(map(quoted, SENTENCES.values()))}])"

    def reading(source: str, end: str) -> str:
        pieces = f"list_filter(list_transform(string_split_regex({source}, {quoted(end)}), lambda s: trim(lower(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g')))), lambda s: s <> '')"
        named = " ".join(f"WHEN regexp_matches(s, {quoted(p)}) THEN {quoted(i)}" for p, i in PATTERNS.items())
        return f"list_filter(list_transform({pieces}, lambda s, i: {{'at': i - 1, 'id': coalesce(({known})[s], CASE {named} END)}}), lambda x: x.id IS NOT NULL)"

    families: dict[str, list[str]] = {}
    for family, licence, sequence in RULES:
        families.setdefault(family, []).append(f"WHEN regexp_matches(ids, {quoted(rule_pattern(sequence))}) THEN {quoted(licence)}")
    rules = ", ".join(f"CASE {' '.join(whens)} END" for whens in families.values())
    leader = f"regexp_replace(regexp_replace(t, {quoted(LEADER)}, '\\1', 'g'), {quoted(OPENING)}, '; \\1', 'g')"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, t, {reading('t', LINE_END)} AS a, {reading(leader, PARAGRAPH_END)} AS b FROM t),
i AS (SELECT *, CASE WHEN len(b) > len(a) THEN b ELSE a END AS f,
 ',' || array_to_string(list_transform(a, lambda x: x.id), ',') || ',;,' || array_to_string(list_transform(b, lambda x: x.id), ',') || ',' AS ids,
 flatten(list_transform(regexp_extract_all(t, {quoted(SPDX.replace('++', '+').replace('*+', '*'))}, 1), lambda x: string_split_regex(x, {quoted(SPDX_WORD)}))) AS tags FROM r)
SELECT doc_id, len(f) AS n_known, array_to_string(list_transform(f, lambda x: x.at || ':' || x.id), ',') AS sentences,
 array_to_string(list_sort(list_distinct(list_concat(list_filter([{rules}], lambda x: x IS NOT NULL),
  list_filter(list_transform(tags, lambda x: regexp_replace(x, '[.]+\\z', '')), lambda x: x <> '')))), ',') AS licences FROM i"""
