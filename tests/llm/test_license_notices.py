"""Notices anywhere in a text: several in a line, behind other trigger words, across lines."""

from weftline.llm import license_scan


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r.doc_id, r.line, r.license, r.n_changed) for r in license_scan.find_licenses(docs).collect())


def test_every_notice_of_a_text(spark):
    prose = "A license to drive is not given here, and copyright is a word. " * 5
    texts = [
        prose + "x " * 3000 + "Released under the MIT License. " + prose + "Licensed under CC BY 4.0.",
        "One.\n\n  // This Source Code Form is subject to the terms of the Mozilla Public\n  // License, v. 2.0.\nReleased under the MIT\nLicense.",
        "Licensed under CC BY-SA 4.0. Licensed under CC BY-SA 4.0.",
        "This source code form is subject to the terms of the Mozilla Public Lic. v. 2.0.",
    ]
    assert found(spark, texts) == [
        (0, 0, "CC-BY-4.0", 0), (0, 0, "MIT", 0),
        (1, 2, "MPL-2.0", 0), (1, 4, "MIT", 0),
        (2, 0, "CC-BY-SA-4.0", 0), (2, 0, "CC-BY-SA-4.0", 0),
        (3, 0, "MPL-2.0", 1),
    ]


def test_usual_texts_and_headers(spark):
    grant = """Copyright (c) 2020 Some One

        Permission is hereby granted, free of charge, to any person obtaining a copy
        of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions:"""
    header = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU {} as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU {} for more details."""
    gpl, lesser = "General Public License", "Lesser General Public License"
    texts = [
        grant,
        header.format(gpl, 3, gpl),
        header.format(gpl, 2, gpl),
        header.format(lesser, 3, lesser),
        "#!/bin/sh\n# SPDX-License-Identifier: Apache-2.0\necho",
        "See https://creativecommons.org/licenses/by-sa/4.0/.",
        "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    ]
    assert found(spark, texts) == [
        (0, 2, "MIT", 0), (1, 0, "GPL-3.0", 0), (2, 0, "GPL-2.0", 0), (3, 0, "LGPL-3.0", 0), (4, 1, "Apache-2.0", 0),
        (5, 0, "CC-BY-SA-4.0", 0), (6, 0, "CC-BY-NC-4.0", 0),
    ]


def test_each_wording_is_its_own_license():
    pairs = tuple((name, text) for name, texts in license_scan.LICENSES.items() for text in texts)
    for name, text in pairs:
        got = license_scan.notices(license_scan.wording(f"foo {text} bar"), pairs, 0.1)
        assert [(r[2], r[4]) for r in got] == [(name, 0)]
