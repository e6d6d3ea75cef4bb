"""Every entry of the catalogue as it is met in files: wrapped anew, owned, decorated, spelt otherwise; and texts that are none."""

import os
import textwrap

import pytest

from lumenspan.llm import license_scan as ls

PUBLISHED = "/usr/share/common-licenses"
FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}


def wrapped(text, width, owner=""):
    return owner + "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False) for p in text.split("\n\n"))


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.license for r in ls.license_scan(docs).collect()}
    return [got[i] for i in range(len(texts))]


def test_entries_under_other_wrapping(spark):
    asked = [(name, text, w) for name, text in ls.LICENSES for w in (40, 64, 72, 79, 1000)]
    owner = "Copyright (c) 2019-2024 Some Body <some@example.org>\nAll rights reserved.\n\n"
    texts = [wrapped(t, w, owner) for _, t, w in asked]
    assert scanned(spark, texts) == [name for name, _, _ in asked]


def test_titles_decorations_and_spellings(spark):
    mit, isc = (next(t for n, t in ls.LICENSES if n == x and "\n" in t) for x in ("MIT", "ISC"))
    body = mit.split("\n\n", 1)[1]
    comment = "/*\n * Copyright 2020 Me\n *\n" + "\n".join(f" * {x}" for x in wrapped(isc, 60).split("\n")) + "\n */"
    texts = [body, "The MIT License (MIT)\n\n(c) Copyright 2001 A\n\n" + body, comment, mit.replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace('"', "“"), mit.upper(), mit + " more", body.replace("free of charge", "at a charge")]
    assert scanned(spark, texts) == ["MIT", "MIT", "ISC", "MIT", "MIT", None, None]


@pytest.mark.parametrize("line", ["copyright notice and this permission notice appear", "(c) you must retain all notices", "Copyrights for the package"])
def test_prose_is_no_copyright_line(line):
    assert ls.canonical_text(f"above\n{line}\nbelow") == " ".join(ls.canonical_text(x) for x in ("above", line, "below"))


@pytest.mark.parametrize("line", ["Copyright (c) 2020 Me", "  * Copyright 1999, 2001 A and B", "(C) Copyright Someone", "© 2021 Me", "Copyright [yyyy] [name]", "Copyright (C) <year> <name>", "All rights reserved."])
def test_copyright_lines(line):
    assert ls.canonical_text(f"above\n{line}\nbelow").split() == ["above", "below"]


@pytest.mark.skipif(not os.path.isdir(PUBLISHED), reason="the published texts aren't here")
def test_published_texts(spark):
    texts = {n: open(f"{PUBLISHED}/{f}").read() for f, n in FILES.items()}
    assert scanned(spark, list(texts.values())) == list(texts)
    assert scanned(spark, [t.replace("\n\n", "\n\n\n") for t in texts.values()]) == list(texts)
    cut = texts["Apache-2.0"][: texts["Apache-2.0"].index("APPENDIX")]
    assert scanned(spark, [cut, texts["GPL-3.0"] + "\nand more"]) == ["Apache-2.0", None]


def test_columns_and_driver_agree(spark):
    texts = [t for _, t in ls.LICENSES] + ["© 2020\nA – “b” c/d", "favour, centre; Whilst wilful_x", "copyright – 2020 x", "", "all rights reserved"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", ls.canonical(df.t).alias("c")).collect()}
    assert [got[i] for i in range(len(texts))] == [ls.canonical_text(t) for t in texts]


def test_rows_without_an_id_have_findings_of_their_own(spark):
    rows = [(None, "Released under the MIT Licence.\n\nmore"), (None, "nothing\n\nhere"), (4, "Licensed under the Apache License, Version 2.0.\nx"), (4, "plain\ntext"), (5, "Released under the MIT Licence.\n\nmore"), (5, "Released under the MIT Licence.\n\nmore"), (6, None)]
    got = ls.license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    alone = {t: ls.license_scan(spark.createDataFrame([(1, t)], "doc_id long, text string")).first() for _, t in rows}
    assert sorted((str(r.doc_id), r.notices, r.n_notices) for r in got) == sorted((str(d), alone[t].notices, alone[t].n_notices) for d, t in rows)
    assert any(r.n_notices for r in got)
