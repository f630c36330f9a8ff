"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences; those that are known sentences of licences become ids,
and the sequence of ids is matched against ordered rules: a rule's ids have to occur
in their order, and the first rule that matches names the licence. A sentence that
isn't known as a whole is cut at its line ends, and each line is looked up in its place,
since notices stand alone on lines and licences are found wrapped; so a sentence counts
once, and the sequence is the text's. Signs that mark lines as comments are taken off
before, so an empty line of a comment parts sentences as any other. Of an SPDX expression
(with OR, AND, WITH and brackets) that isn't known as a whole each identifier counts.

Everything is a projection of one row: a map of known sentences is a literal of the
plan, and no row meets another. Texts without any of a few stems, which every known
sentence has, are not cut at all.

Defined results: null and empty texts have no licence; a very long text is cut whole, in
its row; of several licences the first by the rules' order is named, and all are listed;
repeated sentences count in the sequence; rows that repeat get a row each; null doc_ids
are kept; further columns are ignored whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and notices, normalised, as the cuts leave them: also parted at ; and at "v. ". New ones come last, as ids are their places.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title-2": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-notice-2": "licensed under the gnu general public license version 3",
    "gpl2-notice": "licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-no-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl-notice": "licensed under the gnu lesser general public license version 3",
    "agpl-notice": "licensed under the gnu affero general public license version 3",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-mit": "spdx license identifier mit",
    "spdx-gpl3": "spdx license identifier gpl 3 0 only",
    "spdx-gpl3-later": "spdx license identifier gpl 3 0 or later",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "spdx-mpl": "spdx license identifier mpl 2 0",
    "gpl-modify": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-modify-2": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-modify-3": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-later-2": "either version 2 of the license or at your option any later version",
    "gpl-later-3": "either version 3 of the license or at your option any later version",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl-notice-2": "this source code form is subject to the terms of the mozilla public license v",
    "apache-title": "apache license",
    "apache-definition": "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    "apache-licensor": "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license",
    "apache-grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "apache-trademarks": "this license does not grant permission to use the trade names trademarks service marks or product names of the licensor except as required for reasonable and customary use in describing the origin of the work and reproducing the content of the notice file",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "gpl-copy": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl2-preamble": "the licenses for most software are designed to take away your freedom to share and change it",
    "gpl2-applies": "this license applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this general public license",
    "gpl3-preamble": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "gpl3-refers": "this license refers to version 3 of the gnu general public license",
    "gpl3-propagate": "to propagate a work means to do anything with it that without permission would make you directly or secondarily liable for infringement under applicable copyright law except executing it on a computer or modifying a private copy",
    "agpl3-preamble": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "agpl3-refers": "this license refers to version 3 of the gnu affero general public license",
    "lgpl3-incorporates": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "lgpl21-preamble": "this license the lesser general public license applies to some specially designated software packages typically libraries of the free software foundation and other authors who decide to use it",
    "mpl-title": "mozilla public license version 2 0",
    "mpl-secondary": "secondary license means either the gnu general public license version 2 0 the gnu lesser general public license version 2 1 the gnu affero general public license version 3 0 or any later versions of those licenses",
    "epl-title": "eclipse public license v 2 0",
    "epl-accompanying": "the accompanying program is provided under the terms of this eclipse public license agreement",
    "cc0-waiver": "to the greatest extent permitted by but not in contravention of applicable law affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights and associated claims and causes of action whether now known or unknown including existing as well as future claims and causes of action in the work",
    "wtfpl-copy": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "spdx-bsd2": "spdx license identifier bsd 2 clause",
    "spdx-gpl2": "spdx license identifier gpl 2 0 only",
    "spdx-gpl2-later": "spdx license identifier gpl 2 0 or later",
    "spdx-lgpl21": "spdx license identifier lgpl 2 1 only",
    "spdx-lgpl3": "spdx license identifier lgpl 3 0 only",
    "spdx-agpl3": "spdx license identifier agpl 3 0 only",
    "spdx-isc": "spdx license identifier isc",
    "spdx-epl": "spdx license identifier epl 2 0",
    "spdx-unlicense": "spdx license identifier unlicense",
    "spdx-cc0": "spdx license identifier cc0 1 0",
    "spdx-zlib": "spdx license identifier zlib",
    "spdx-bsl": "spdx license identifier bsl 1 0",
    "spdx-0bsd": "spdx license identifier 0bsd",
    "agpl-modify": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-modify": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl-later-21": "either version 2 1 of the license or at your option any later version",
    "mit-project": "this project is licensed under the mit license",
    "mit-see": "licensed under the mit license see the license file",
    "mit-see-2": "licensed under the mit license see the license file for details",
    "mit-see-3": "this project is licensed under the mit license see the license file for details",
    "mit-see-4": "this project is licensed under the mit license see the license md file for details",
    "mit-distributed": "distributed under the mit license",
    "apache-short": "licensed under the apache license 2 0",
    "apache-project": "this project is licensed under the apache license 2 0",
    "apache-see-2": "this project is licensed under the apache license 2 0 see the license file for details",
    "apache-see-3": "licensed under the apache license version 2 0 see the license file for details",
    "gpl3-project": "this project is licensed under the gnu general public license v3 0",
    "bsd3-project": "this project is licensed under the bsd 3 clause license",
}

#: Ordered rules: a licence, and ids that occur in this order.
RULES = (
    ("AGPL-3.0", ("agpl3-preamble", "agpl3-refers", "gpl3-propagate")),
    ("GPL-3.0", ("gpl3-preamble", "gpl3-refers", "gpl3-propagate")),
    ("GPL-2.0", ("gpl2-preamble", "gpl2-applies")),
    ("LGPL-2.1", ("lgpl21-preamble",)),
    ("LGPL-3.0", ("gpl-copy", "lgpl3-incorporates")),
    ("MPL-2.0", ("mpl-title", "mpl-secondary")),
    ("EPL-2.0", ("epl-title", "epl-accompanying")),
    ("Apache-2.0", ("apache-title", "apache-definition", "apache-licensor", "apache-grant", "apache-trademarks")),
    ("CC0-1.0", ("cc0-waiver",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("WTFPL", ("wtfpl-copy",)),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-no-warranty", "gpl-implied")),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("AGPL-3.0-or-later", ("agpl-modify",)),
    ("LGPL-2.1-or-later", ("lgpl-free",)),
    ("LGPL-2.1-or-later", ("lgpl-modify", "lgpl-later-21")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-no-warranty", "gpl-implied")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-no-warranty", "gpl-implied")),
    ("GPL-3.0-or-later", ("spdx-gpl3-later",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-3.0-or-later", ("gpl-modify", "gpl-later-3")),
    ("GPL-3.0-or-later", ("gpl-modify-3",)),
    ("GPL-2.0-or-later", ("gpl-modify", "gpl-later-2")),
    ("GPL-2.0-or-later", ("gpl-modify-2",)),
    ("AGPL-3.0-only", ("agpl-notice",)),
    ("LGPL-3.0-only", ("lgpl-notice",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-only", ("gpl3-notice-2",)),
    ("GPL-3.0-only", ("spdx-gpl3",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("MPL-2.0", ("mpl-notice-2",)),
    ("MPL-2.0", ("spdx-mpl",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("Apache-2.0", ("apache-header", "apache-comply", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-header", "apache-comply")),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("MIT", ("mit-grant", "mit-keep", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-keep", "mit-as-is")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-2",)),
    ("MIT", ("mit-title", "mit-grant")),
    ("MIT", ("mit-title-2", "mit-grant")),
    ("MIT", ("spdx-mit",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("spdx-isc",)),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("0BSD", ("spdx-0bsd",)),
    ("Unlicense", ("unlicense",)),
    ("Unlicense", ("spdx-unlicense",)),
    ("BSD-2-Clause", ("spdx-bsd2",)),
    ("GPL-2.0-only", ("spdx-gpl2",)),
    ("GPL-2.0-or-later", ("spdx-gpl2-later",)),
    ("LGPL-2.1-only", ("spdx-lgpl21",)),
    ("LGPL-3.0-only", ("spdx-lgpl3",)),
    ("AGPL-3.0-only", ("spdx-agpl3",)),
    ("EPL-2.0", ("spdx-epl",)),
    ("CC0-1.0", ("spdx-cc0",)),
    ("Zlib", ("spdx-zlib",)),
    ("BSL-1.0", ("spdx-bsl",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("MIT", ("mit-project",)),
    ("MIT", ("mit-see",)),
    ("MIT", ("mit-see-2",)),
    ("MIT", ("mit-see-3",)),
    ("MIT", ("mit-see-4",)),
    ("MIT", ("mit-distributed",)),
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-project",)),
    ("Apache-2.0", ("apache-see-2",)),
    ("Apache-2.0", ("apache-see-3",)),
    ("GPL-3.0-only", ("gpl3-project",)),
    ("BSD-3-Clause", ("bsd3-project",)),
)

#: Each known sentence has one of these.
STEMS = ("licen", "permi", "redistribut", "copyright", "warrant", "public domain")

_NUMBER = {name: i for i, name in enumerate(SENTENCES, 1)}


def _pattern(ids: tuple[str, ...]) -> str:
    return "%" + "%".join(f"|{_NUMBER[i]}|" for i in ids) + "%"


def _matches(column: str, ids: tuple[str, ...]) -> str:
    return f"({column} LIKE '{_pattern(ids)}')"


def _names(column: str) -> dict[str, str]:
    """Of each licence, SQL that is true where one of its rules matches, in the order of their first rules."""
    out: dict[str, list[str]] = {}
    for licence, ids in RULES:
        out.setdefault(licence, []).append(_matches(column, ids))
    return {k: " OR ".join(v) for k, v in out.items()}


def _first(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {_matches(column, ids)} THEN '{licence}'" for licence, ids in RULES) + " END"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids in their order, license (null if none) and licenses (all, in the rules' order)."""
    known = F.create_map(*[F.lit(x) for text, i in ((SENTENCES[k], n) for k, n in _NUMBER.items()) for x in (text, i)])
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = docs.select("doc_id", text.alias("_text"))
    worth = F.lit(False)
    for stem in STEMS:
        worth = worth | F.contains("_text", F.lit(stem))
    number = lambda s: F.try_element_at(known, F.trim(F.regexp_replace(s, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " ")))
    known_ones = lambda x: F.filter(x, lambda i: i.isNotNull())
    spdx = lambda line: known_ones(F.transform(F.split(F.regexp_extract(line, SPDX, 1), JOINS), lambda i: number(F.concat(F.lit("spdx license identifier "), i))))
    line = lambda x: F.transform(F.array(number(x)), lambda i: F.when(i.isNotNull(), F.array(i)).when(F.contains(x, F.lit("spdx-license-identifier")), spdx(x)))[0]
    lines = lambda s: F.flatten(F.filter(F.transform(F.split(s, "\n"), line), lambda x: x.isNotNull()))
    sentences = F.split(F.regexp_replace(F.regexp_replace("_text", f"(?md){MARKS}", ""), ENDS, "\x01"), "\x01")
    ids = F.flatten(F.transform(sentences, lambda s: F.coalesce(F.transform(F.array(number(s)), lambda i: F.when(i.isNotNull(), F.array(i)))[0], lines(s))))
    out = out.select("doc_id", F.when(worth, ids).otherwise(F.array().cast("array<int>")).alias("_found"))
    out = out.select("doc_id", F.size("_found").cast("long").alias("n_sentences"), F.concat_ws("", F.transform("_found", lambda i: F.concat(F.lit("|"), i.cast("string"), F.lit("|")))).alias("_ids"))
    names = F.array_join(F.filter(F.array(*[F.expr(f"CASE WHEN {sql} THEN '{k}' END") for k, sql in _names("_ids").items()]), lambda x: x.isNotNull()), ",")
    return out.select("doc_id", "n_sentences", F.col("_ids").alias("sentence_ids"), F.expr(_first("_ids")).alias("license"), names.alias("licenses"))


#: Where a sentence ends: points before white space, and empty lines.
ENDS = r"[.!?;]+([ \t\n\r]|$)|\n[ \t\r]*\n"

#: Signs that mark a line as a comment, at its beginning or end; of an expression its identifiers, and what joins them.
MARKS = r"^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|%+|<!--)[ \t]*|[ \t]*(?:\*+/|-->)[ \t\r]*$"
SPDX = r"spdx-license-identifier:?(.*)"
JOINS = r"[ \t()]+(?:or|and|with)[ \t()]+"


def _oracle() -> str:
    """Rows of sentences joined with tables of known sentences and of the rules' steps; each step is found after the one before."""
    known = ", ".join(f"('{SENTENCES[k]}', {n})" for k, n in _NUMBER.items())
    steps = ", ".join(f"({rule}, '{licence}', {step}, {_NUMBER[i]}, {len(ids)})" for rule, (licence, ids) in enumerate(RULES) for step, i in enumerate(ids))
    most = max(len(ids) for _, ids in RULES)
    plain = r"trim(regexp_replace({}, '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")
    chain = "m0 AS (SELECT r, rule, min(pos) AS pos FROM seq JOIN steps ON step = 0 AND seq.i = steps.i GROUP BY ALL)"
    for k in range(1, most):
        chain += f",\nm{k} AS (SELECT m.r, m.rule, min(seq.pos) AS pos FROM m{k - 1} m JOIN steps ON steps.rule = m.rule AND step = {k} JOIN seq ON seq.r = m.r AND seq.i = steps.i AND seq.pos > m.pos GROUP BY ALL)"
    ends = " UNION ALL ".join(f"SELECT r, rule FROM m{k} SEMI JOIN (SELECT rule FROM steps WHERE n = {k + 1}) USING (rule)" for k in range(most))
    return rf"""
WITH known(s, i) AS (VALUES {known}),
steps(rule, licence, step, i, n) AS (VALUES {steps}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '(?m){MARKS}', '', 'g') AS t FROM documents),
cut AS (SELECT r, unnest(x) AS s, generate_subscripts(x, 1) AS a FROM (SELECT r, string_split(regexp_replace(t, '{ENDS}', chr(1), 'g'), chr(1)) AS x FROM d)),
sentence AS (SELECT r, a, cut.s AS raw, i FROM cut LEFT JOIN known ON known.s = {plain.replace("{}", "cut.s")}),
line AS (SELECT r, a, unnest(x) AS s, generate_subscripts(x, 1) AS b FROM (SELECT r, a, string_split(raw, chr(10)) AS x FROM sentence WHERE i IS NULL)),
whole AS (SELECT r, a, b, line.s AS raw, known.i FROM line LEFT JOIN known ON known.s = {plain.replace("{}", "line.s")}),
part AS (SELECT r, a, b, unnest(x) AS s, generate_subscripts(x, 1) AS c FROM (SELECT r, a, b, string_split_regex(regexp_extract(raw, '{SPDX}', 1), '{JOINS}') AS x FROM whole WHERE i IS NULL AND contains(raw, 'spdx-license-identifier'))),
seq AS (
  SELECT r, i, row_number() OVER (PARTITION BY r ORDER BY a, b, c) AS pos FROM (
    SELECT r, a, 0 AS b, 0 AS c, i FROM sentence WHERE i IS NOT NULL
    UNION ALL SELECT r, a, b, 0, i FROM whole WHERE i IS NOT NULL
    UNION ALL SELECT r, a, b, c, known.i FROM part JOIN known ON known.s = {plain.replace("{}", "('spdx license identifier ' || part.s)")})),
{chain},
matched AS ({ends}),
firsts AS (SELECT licence, min(rule) AS place FROM steps GROUP BY licence),
named AS (SELECT r, licence, min(rule) AS rule FROM matched JOIN (SELECT DISTINCT rule, licence FROM steps) USING (rule) GROUP BY ALL),
found AS (SELECT r, arg_min(licence, rule) AS license, string_agg(licence, ',' ORDER BY place) AS licenses FROM named JOIN firsts USING (licence) GROUP BY r),
ids AS (SELECT r, count(*) AS n, string_agg('|' || i || '|', '' ORDER BY pos) AS ids FROM seq GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, license, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN ids USING (r) LEFT JOIN found USING (r)
"""


ORACLE = _oracle()
