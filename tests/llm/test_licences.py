from __future__ import annotations

import textwrap

import helpers
import pytest
from trailmark.llm import licences

PLAIN = {
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "gpl": "GNU General Public License, version 3",
    "apache-2.0": "Apache License, Version 2.0",
    "mit": "MIT License",
}


@pytest.fixture(scope="module")
def model(spark):
    return licences.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_whole_table_against_the_wordings(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = licences.scan_licences(helpers.with_clashes(docs), model).collect()
    assert len(found) == len(texts)
    for row in found:
        want = sorted(name for name, wording in PLAIN.items() if wording in texts[row.doc_id])
        assert row.licences == ",".join(want)


@pytest.mark.parametrize(
    "text, family",
    [
        ("LICENSED UNDER THE MIT LICENSE", "mit"),
        ("Released under the BSD 3-Clause License.", "bsd"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
        ("// SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
        ("Proprietary and confidential. All rights reserved.", "proprietary"),
        ("The driver has a license plate.", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_single_paragraphs(spark, model, text, family):
    table = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert licences.scan_licences(table, model).head().licences == family


def test_odd_rows(spark, model):
    notice = "Released under the MIT License."
    rows = [(None, notice), (2, "x " * 100_000 + "\n" + notice), (2, notice + "\r\n" + notice)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = licences.scan_licences(table, model).collect()
    assert [r.licences for r in found] == ["mit"] * 3
    assert [r.n_notices for r in found] == [1, 1, 2]
    assert licences.scan_licences(table.limit(0), model).count() == 0


def test_training_on_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    model = licences.train(empty)
    table = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id bigint, text string")
    assert licences.scan_licences(table, model).head().licences == "mit"


GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, "
    "or (at your option) any later version."
)
LGPL = (
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
    "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
    "License, or (at your option) any later version."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: 1. Redistributions of source code must retain the above notice."
)
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the Software), to deal in the Software without restriction."
)
APACHE = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at the usual place."
)
HEADERS = {"gpl": GPL, "lgpl": LGPL, "bsd": BSD, "mit": MIT, "apache-2.0": APACHE}
STYLES = [("", "", ""), ("/*\n", " * ", "\n */"), ("", "# ", ""), ("", "// ", ""), ("<!--\n", "  -- ", "\n-->")]


def in_style(text, style, width=70):
    before, mark, after = style
    return before + "\n".join(mark + line for line in textwrap.wrap(text, width)) + after


def test_wrapped_headers(spark, model):
    rows, want = [], {}
    for family, header in HEADERS.items():
        for style in STYLES:
            for width in (40, 70):
                text = f"Some words before it.\n\n{in_style(header, style, width)}\n\nimport something\nand go on"
                want[len(rows)] = family
                rows.append((len(rows), text))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.licences for r in licences.scan_licences(table, model).collect()}
    assert found == want


def test_several_notices_in_one_line_or_block(spark, model):
    two = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    filler = "plain words of a long text that goes on " * 300
    texts = {
        two: "apache-2.0,mit",
        two.replace(". L", ".\nL"): "apache-2.0,mit",
        "\n".join([in_style(GPL, STYLES[1]), "", in_style(BSD, STYLES[1])]): "bsd,gpl",
        in_style(f"{LGPL} {APACHE}", STYLES[2]): "apache-2.0,lgpl",
        f"{filler}{two} {filler}{MIT}": "apache-2.0,mit",
    }
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.licences for r in licences.scan_licences(table, model).collect()}
    assert found == dict(enumerate(texts.values()))


@pytest.mark.parametrize("shift", range(0, 60, 7))
def test_a_notice_anywhere_in_a_long_line(spark, model, shift):
    text = "word " * (100 + shift) + LGPL + " and more" * 100
    table = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = licences.scan_licences(table, model).head()
    assert row.licences == "lgpl"
    assert sum(n.confirmed for n in row.notices) == 1


def test_many_blank_lines(spark, model):
    text = "Released under\n" + "\n" * 200_000 + "the MIT License.\n" + " * \n" * 50_000 + "Released under the\nMIT License."
    table = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = licences.scan_licences(table, model).head()
    assert [n.paragraph for n in row.notices if n.confirmed] == [row.n_paragraphs - 1]
