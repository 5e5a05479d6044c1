"""Genuine notices, near misses, gaps and long texts; the SQL twin over the same rows."""

import duckdb
import pytest

from haulage.llm import licenses

GENUINE = {
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause-name",
    "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1",
    "// SPDX-License-Identifier: Apache-2.0 OR MIT": "Apache-2.0,MIT,choice-of-licenses",
    "SPDX-License-Identifier: 0BSD": "0BSD",
    "The MIT License (MIT)\n\nCopyright (c) 2020 Someone": "MIT",
    "Distributed under the MIT License. See LICENSE for more.": "MIT",
    "This project is not only released under the MIT license.": "MIT",
    "Licence: ISC": "ISC-name",
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "Apache-2.0,MIT,choice-of-licenses",
    "This program and the accompanying materials are made available under the\n * terms of the Eclipse Public License v. 2.0 which is available at x": "EPL-2.0",
    "made available under the terms of the Eclipse Public License v. 2.0 which is available at x": "EPL-2.0",
    "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file)": "BSL-1.0",
    "This is released under the zlib License.": "Zlib",
    "Released under CC0 1.0 Universal.": "CC0-1.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
    "This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.": "OFL-1.1",
    "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")": "MPL-1.1",
    "Licensed under the EUPL, Version 1.2 or later": "EUPL-1.2",
    "licensed under the GNU Affero General Public License, version 3": "AGPL-3.0",
    "This library is free software; you can redistribute it and/or\n modify it under the terms of the GNU Lesser General Public\n License as published by the Free Software Foundation; either\n version 2.1 of the License": "LGPL-2.1,LGPL-grant",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.": "CC0-1.0-waiver",
    "In no event will the authors be held liable for any damages arising from the use of this software.\n\n1. The origin of this software must not be misrepresented; you must not claim it.\n2. Altered source versions must be plainly marked as such.": "Zlib-text",
    "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation": "BSL-1.0,BSL-1.0-text",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted": "ISC",
    "This file is released under GPLv2 and LGPLv3.": "GPL-2.0,LGPL-3.0",
    "Available under the PostgreSQL License.": "PostgreSQL",
    "This license governs use of the accompanying software.": "MS-text",
}
NEAR_MISSES = [
    "This is not licensed under the MIT license.",
    "It is no longer released under the Apache License, Version 2.0.",
    "Neither is it distributed under GPLv3.",
    "The MIT campus licensed its software.",
    "A licence to drive is subject to a test of the eyes.",
    "We compared the MIT license and the BSD license.",
    "All rights are reserved to nobody.",
    "Under the table lay the Apache helicopter 2.0.",
    "Copyright is covered by law; zlib is a library.",
    "Permission is hereby granted to leave the room.",
    "released undercover mit",
]
MIT = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", "The above copyright notice and this permission notice shall be included in all copies.", "The software is provided as is, without warranty of any kind."]


def rows():
    texts = list(GENUINE) + NEAR_MISSES
    texts += [f"{MIT[0]} All rights reserved. Some word. {MIT[1]} {MIT[2]}", f"{MIT[0]} {'Other words. ' * 9}{MIT[1]} {MIT[2]}", f"{MIT[0]} {'Other words. ' * 8}{MIT[1]} {MIT[2]}", f"{MIT[1]} {MIT[0]} {MIT[2]}"]
    texts += [None, "", " . ! \n\n ", "licence " * 50_000 + "Released under the MIT License", "not " * 50_000, "İ licensed under mit", texts[0]]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def got(spark):
    return sorted(tuple(r) for r in licenses.scan(spark.createDataFrame(rows(), "doc_id long, text string")).collect())


def test_genuine_and_near_misses(got):
    by_id = {r[0]: r for r in got}
    for i, (text, want) in enumerate(GENUINE.items()):
        assert by_id[i][3] == want, text
    at = len(GENUINE)
    for i, text in enumerate(NEAR_MISSES, at):
        assert by_id[i][3] == "", text
    at += len(NEAR_MISSES)
    assert [by_id[at + i][3] for i in range(4)] == ["MIT-text,all-rights-reserved", "", "MIT-text", ""]
    assert by_id[at + 4][1:] == by_id[at + 5][1:] == by_id[at + 6][1:] == (0, "", "")
    assert by_id[at + 7][3] == "MIT" and by_id[at + 8][3] == "" and by_id[at + 9][3] == "MIT" and by_id[at + 10][3] == by_id[0][3]


def test_same_as_sql(got):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows())
    rel = con.sql(licenses.oracle())
    assert sorted(rel.project("doc_id, n_sentences, sentence_ids, licenses").fetchall()) == got


def test_every_known_form_is_found(spark):
    own = [(i, s) for s, i in licenses.SENTENCES.items()] + [(i, f"{licenses.LEADS[k % len(licenses.LEADS)]} {form}") for i, forms in licenses.NAMES.items() for k, form in enumerate(forms)]
    back = {tuple(r) for r in licenses.scan(spark.createDataFrame(own, "doc_id string, text string")).select("doc_id", "sentence_ids").collect()}
    assert all(i in ids.split(",") for i, ids in back) and {i for rule in licenses.RULES.values() for i in rule} - {"CHOICE"} == {i for i, _ in own}
    assert spark.createDataFrame([], "doc_id long, text string").transform(licenses.scan).count() == 0
