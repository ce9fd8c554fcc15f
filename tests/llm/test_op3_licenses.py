import pytest

from docnav.llm import op3_licenses as op

from .conftest import DOCS, prose

M = op.Matcher()


@pytest.mark.parametrize(("name", "text"), op.TEMPLATES)
def test_each_template_is_found_in_prose(name, text):
    body = f"{prose(1, 40)}.\n{text}\n{prose(2, 30)}."
    got = op.scan_text(body, M)
    assert got[1] == name and got[3] == ""
    _, start, end = got[2].rsplit(":", 2)
    assert text.rstrip(".:/").removeprefix("SPDX-License-Identifier: ") in body[int(start) : int(end)]


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("licensed under the apache license, version 2.0", "Apache-2.0"), ("Licensed under the Apache License, Version 1.1.", ""), ("Released under the Foo License.", ""), ("This work is licensed under the GNU General Public License, version 4.", ""),
        ("This book is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("Licensed under CC BY-NC 3.0.", ""), ("The licence fee is due. Copyright fades.", ""), ("License to permission copyright warranty", ""), ("Licensed under CC BY-NC-ND 4.0.", ""),
    ],
)
def test_wording_decides(text, name):
    assert op.scan_text(f"{prose(3, 12)}. {text}\n{prose(4, 9)}", M)[1] == name


def test_differing_words_are_listed():
    assert op.scan_text("This book is licensed under the GNU General Public License, version 3.", M)[3] == "-work +book"


def test_all_lines_of_a_long_text_are_found():
    text = "\n".join(prose(i, 60) + (".\nReleased under the MIT License." if i % 7 == 0 else ".") for i in range(400))
    assert op.scan_text(text, M)[2].count("MIT:") == 58


def test_without_triggers_there_is_nothing():
    assert op.scan_text(prose(5, 5000), M) == (0, "", "", "")


def test_odd_rows(spark, odd, none):
    got = sorted((tuple(r) for r in op.scan(odd).collect()), key=str)
    assert got == sorted(((r.doc_id, *op.scan_text(r.text, M)) for r in odd.collect()), key=str)
    two = spark.createDataFrame([(i, "Licensed under CC BY 4.0.", None, None, None, None, None, None) for i in (1, 1, None)], DOCS)
    assert [r.licenses for r in op.scan(two).collect()] == ["CC-BY-4.0"] * 3
    assert op.scan(none).count() == 0


@pytest.mark.parametrize("n", [0, 20, 3000])
@pytest.mark.parametrize(("name", "text"), op.TEMPLATES[::3])
def test_other_words_of_a_block_hide_no_notice(name, text, n):
    # neighbours within GAP characters and a line without an end are one block
    chained = " ".join(f"{prose(i, 12)} copyright." for i in range(n // 14))
    assert op.scan_text(f"{chained} {text} {chained}", M)[1] == name
    assert op.scan_text(f"{prose(1, n)} {text.rstrip('.')} {prose(2, n)}", M)[1] == name


def test_differing_words_far_from_others_are_listed():
    far = f"This fee. {prose(1, 30)} copyright. {prose(2, 25)} version 4. "
    assert op.scan_text(f"{far}This book was licensed under the GNU General Public License, version 3. {far}", M)[1::2] == ("GPL-3.0", "-work -is +book +was")
    assert op.scan_text(f"{far}Licensed under the MIT 2.0 License. {far}", M)[1] == ""


def test_all_notices_of_a_block_are_found():
    mit, apache = "Licensed under the MIT License.", "Licensed under the Apache License, Version 2.0."
    text = f"{mit}\n{apache} {mit} Also: {apache[:-1]} or {mit[:-1]}"
    got = op.scan_text(text, M)
    assert got[:2] == (1, "Apache-2.0,MIT") and got[3] == ""
    spans = [x.rsplit(":", 2) for x in got[2].split(",")]
    assert [(n, text[int(a) : int(b)]) for n, a, b in spans] == [("MIT", mit[:-1]), ("Apache-2.0", apache[:-1]), ("MIT", mit[:-1]), ("Apache-2.0", apache[:-1]), ("MIT", mit[:-1])]
    for one, x in op.TEMPLATES[::7]:
        for two, y in op.TEMPLATES[3::5]:
            found = op.scan_text(f"{x}\n{prose(1, 3)}. {y}", M)
            assert (found[1], found[2].count(":"), found[3]) == (",".join(sorted({one, two})), 4, ""), (x, y)


def test_many_notices_of_one_block_are_found_in_time_that_grows_with_it():
    assert op.scan_text("\n".join(["Released under the MIT License."] * 4000), M)[2].count("MIT:") == 4000


VERBATIM = {
    "MIT": """MIT License

Copyright (c) 2020 A Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
""",
    "GPL-3.0": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
""",
}


@pytest.mark.parametrize("name", VERBATIM)
def test_verbatim_notices_are_found(name):
    for n in (0, 300):
        assert op.scan_text(f"{prose(1, n)}\n{VERBATIM[name]}\n{prose(2, n)}", M)[1] == name


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Licensed under the MIT License.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0,MIT"), ("Released under the MIT License. Licensed under CC BY 4.0.", "CC-BY-4.0,MIT"), ("It is available under the MIT License or the Apache License.", "Apache,MIT"),
        ("// SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: (Apache-2.0 OR GPL-3.0-only) AND CC0-1.0", "Apache-2.0,CC0-1.0,GPL-3.0"), ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "GPL-2.0"), ("SPDX-License-Identifier: Foo-9.0", ""),
    ],
)
def test_several_licenses_and_expressions(text, names):
    assert op.scan_text(text, M)[1] == names


def exact(text):
    """Every template as a sequence of words in the whole text, without blocks, ranks or alignment; not those within a longer one."""
    own = op.words(text)
    at = [(i, i + len(want), name) for name, t in op.TEMPLATES for want in [op.words(t)] for i in range(len(own) - len(want) + 1) if own[i : i + len(want)] == want]
    return {name for a, b, name in at if not any(c <= a and b <= d and d - c > b - a for c, d, _ in at)}


def test_recall_against_an_exact_scan_of_whole_texts():
    import random

    r, found, there = random.Random(8), 0, 0
    for i in range(150):
        words = prose(i, 50 * (1 + i % 12)).split()
        for _ in range(r.randrange(1, 4)):
            at = r.randrange(len(words))
            words[at:at] = [r.choice(op.TEMPLATES)[1]]
        text = " ".join(words)
        want, got = exact(text), set(op.scan_text(text, M)[1].split(","))
        found, there = found + len(want & got), there + len(want)
    assert found >= 0.97 * there, (found, there)


#: Notices as they are found in the wild, not taken from TEMPLATES.
WILD = [
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    ("is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0"), ("made available under a Creative Commons Attribution 4.0 International license", "CC-BY-4.0"),
    ("This project is licensed under the terms of the MIT license.", "MIT"), ("License: MIT", "MIT"), ("The code is released under the MIT license - see the LICENSE file", "MIT"), ("All code here is available under the Apache 2.0 license.", "Apache-2.0"),
    ("\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n", "Apache-2.0"),
    ("\n                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n", "GPL-3.0"),
    ("it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "GPL-2.0"), ("// SPDX-License-Identifier: BSL-1.0", "BSL-1.0"), ("Distributed and licensed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", "Zlib"),
    ("This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
]


def test_notices_of_the_wild_are_found():
    right = [op.scan_text(f"{prose(1, 30)}. {text}\n{prose(2, 30)}", M)[1] == name for text, name in WILD]
    assert sum(right) >= 0.9 * len(WILD), [w for w, r in zip(WILD, right, strict=True) if not r]


@pytest.mark.parametrize("text", ["Not licensed under the MIT License.", "This is not licensed under the MIT License.", "It was never released under the ISC License.", "Licensed under a Creative Commons Attribution-Sampling 4.0 International License."])
def test_what_is_denied_or_unknown_names_nothing(text):
    assert op.scan_text(f"{prose(3, 12)}. {text}\n{prose(4, 9)}", M)[1] == ""


def test_compression_ranks_and_admits(monkeypatch):
    """With savings that tell nothing, other templates are confirmed, or none."""
    text = f"{prose(1, 20)}. {VERBATIM['BSD-3-Clause']} {prose(2, 20)}. Licensed under the Apache License, Version 2.0."
    usual = op.scan_text(text, M)
    assert usual[1] == "Apache-2.0,BSD-3-Clause"
    monkeypatch.setattr(op.Matcher, "savings", lambda self, text, scale: dict.fromkeys(self.scale[scale], 0))
    assert op.scan_text(text, M)[1] == ""
    monkeypatch.setattr(op.Matcher, "savings", lambda self, text, scale: dict.fromkeys(self.scale[scale], 100))
    assert op.scan_text(text, M)[1:] != usual[1:]
