import pyarrow as pa
import pyarrow.parquet as pq

from faultline.llm import licenses

MIT = """MIT License

Copyright (c) 2020 A B

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"""


def test_known_sentences_are_normal_and_have_a_stem():
    for s in licenses.SENTENCES.values():
        assert s == " ".join(s.split()) and any(x in s for x in licenses.STEMS)
    assert {i for _, ids in licenses.RULES for i in ids} <= set(licenses.SENTENCES)


def test_rules(spark):
    texts = {
        1: MIT,
        2: "Prose ends.\nLicensed under the Apache License, Version 2.0.",
        3: "| a table\nReleased under the MIT License. Licensed under CC BY-NC 4.0.",
        4: "it is not licensed under anything",
        5: None,
        6: "",
        7: "SPDX-License-Identifier: GPL-3.0-or-later",
        8: "x " * 100_000 + "\nThis work is licensed under the GNU General Public License, version 3.",
        9: "Prélicensed under the MIT license",
    }
    want = {1: "MIT", 2: "Apache-2.0", 3: "MIT", 4: None, 5: None, 6: None, 7: "GPL-3.0-or-later", 8: "GPL-3.0-only", 9: None}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()] + [(None, None, "y")], "doc_id long, text string, license string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert {k: got[k].license for k in want} == want
    assert got[3].licenses == "MIT,CC-BY-NC-4.0" and got[None].n_sentences == 0
    assert licenses.scan(df.limit(0)).collect() == []


#: Written by hand: comments of several kinds, expressions and short mentions, and what looks like them but is none.
MARKED = {
    1: ("MIT", "\n".join(f"# {x}".rstrip() for x in MIT.split("\n"))),
    2: ("MIT", "/*\n" + "\n".join(f" * {x}".rstrip() for x in MIT.split("\n")) + "\n */\nint main() { }"),
    3: ("MIT", "<!--\n" + MIT + "\n-->"),
    4: ("MIT", "\n".join(f";; {x}".rstrip() for x in MIT.split("\n"))),
    5: ("Apache-2.0,MIT", "// SPDX-License-Identifier: Apache-2.0 OR MIT"),
    6: ("GPL-2.0-or-later,BSD-3-Clause", "/* SPDX-License-Identifier: (GPL-2.0-or-later AND BSD-3-Clause) */\nx"),
    7: ("GPL-2.0-only", "# SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note"),
    8: ("GPL-3.0-or-later", "-- SPDX-License-Identifier: GPL-3.0-or-later"),
    9: ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    10: ("MIT", "licensed under the MIT License - see the LICENSE file"),
    11: ("MIT", "* This project is licensed under the MIT License - see the [LICENSE.md] file for details"),
    12: ("", "SPDX-License-Identifier: LicenseRef-Own OR NONE"),
    13: ("", "this project is not licensed under the mit license or any other"),
    14: ("", "# permission is asked\n#\n# of everyone"),
    15: ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
}


def test_comments_expressions_and_mentions(spark, tmp_path):
    from tests.oracle import compare

    rows = [(k, t) for k, (_, t) in MARKED.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    assert {k: set(v.split(",")) for k, v in got.items()} == {k: set(v.split(",")) for k, (v, _) in MARKED.items()}
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}), f"{tmp_path}/documents.parquet")
    compare(spark, str(tmp_path), lambda s, d: licenses.scan(s.read.parquet(f"{d}/documents.parquet")), licenses.ORACLE)


def test_every_planted_line_is_found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id for r in licenses.scan(docs).where("license IS NOT NULL").collect()}
    assert got == {r.doc_id for r in docs.where(r"text rlike '(?i)(licensed|released) under'").select("doc_id").collect()}


WARRANTY = """
This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
""" + WARRANTY
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
""" + WARRANTY
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy or use this software."""


def test_verbatim_notices(spark):
    comment = lambda s: "/*\n" + "\n".join(f" * {x}" for x in s.split("\n")) + "\n */"
    second = GPL2.replace("Foundation; either", "Foundation, either")
    notices = [
        (GPL2, "GPL-2.0-or-later", 4),
        (second, "GPL-2.0-or-later", 3),
        (GPL2.replace("version 2", "version 3"), "GPL-3.0-or-later", 4),
        (second.replace("version 2", "version 3"), "GPL-3.0-or-later", 3),
        (GPL3, "GPL-3.0-or-later", 3),
        (MPL, "MPL-2.0", 1),
        (MPL.replace("v. 2.0", "v.2.0"), "MPL-2.0", 1),
    ]
    texts = [t for text, *_ in notices for t in (text, comment(text))] + [UNLICENSE]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(len(texts))] == [x for _, name, _ in notices for x in (name, name)] + ["Unlicense"]
    assert [got[i].n_sentences for i in range(2 * len(notices))] == [x for *_, n in notices for x in (n, n)]


HEADER = "Licensed under the Apache License, Version 2.0 (the License);"
COMPLY = "you may not use this file except in compliance with the License."


def scanned(spark, *texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(r.license, r.n_sentences) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_order_counts(spark):
    """A rule's sentences in another order are no match, and a sentence counts once however it is cut."""
    grant, source, binary = (licenses.SENTENCES[k] + "." for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    endorse = licenses.SENTENCES["bsd-endorse"] + "."
    assert scanned(
        spark,
        f"{HEADER}\n{COMPLY}",
        f"{COMPLY}\n\n{HEADER}",
        "Released under the MIT license.",
        "Released under the\nMIT license.",
        " ".join((grant, source, binary, endorse)),
        " ".join((grant, source, binary)),
        " ".join((endorse, binary, source, grant)),
        "\n".join((grant, binary, source, binary)),
        "Released under the MIT License\nReleased under the MIT License",
    ) == [("Apache-2.0", 2), (None, 2), ("MIT", 1), ("MIT", 1), ("BSD-3-Clause", 4), ("BSD-2-Clause", 3), (None, 4), ("BSD-2-Clause", 4), ("MIT", 2)]


def test_every_rule_matches_its_sentences_in_order_only(spark):
    texts = [". \n".join(licenses.SENTENCES[i] for i in ids) + "." for _, ids in licenses.RULES]
    back = [". \n".join(licenses.SENTENCES[i] for i in reversed(ids)) + "." for _, ids in licenses.RULES]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts + back)), "doc_id long, text string")).collect()
    got = {r.doc_id: r.licenses.split(",") for r in rows}
    for k, (name, ids) in enumerate(licenses.RULES):
        assert name in got[k]
        shorter = any(n == name and set(x) <= set(ids) and x != ids and (len(x) == 1 or [ids.index(i) for i in x] == sorted(ids.index(i) for i in x)[::-1]) for n, x in licenses.RULES)
        if len(ids) > 1 and not shorter:
            assert name not in got[k + len(licenses.RULES)]


def test_oracle_on_hand_written_texts(spark, tmp_path):
    """The SQL, by joins of rows, and the scan, by one projection, agree where order and repeats matter."""
    from tests.oracle import compare

    some = [". ".join(licenses.SENTENCES[i] for i in ids) for _, ids in licenses.RULES]
    texts = [MIT, GPL2, GPL3, MPL, UNLICENSE, f"{HEADER} {COMPLY}", f"{COMPLY} {HEADER}", None, "", *some, *[".\n\n".join(reversed(x.split(". "))) for x in some], *[a + ".\n" + b for a, b in zip(some, some[7:])]]
    rows = [(i % 11 or None, t) for i, t in enumerate(texts)] * 2
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}), f"{tmp_path}/documents.parquet")
    compare(spark, str(tmp_path), lambda s, d: licenses.scan(s.read.parquet(f"{d}/documents.parquet")), licenses.ORACLE)
