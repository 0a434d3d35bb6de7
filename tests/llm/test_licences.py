from pyspark.sql import functions as F

from vacantia.llm import licences

MIT = """Copyright (c) 2020 Someone. Permission is hereby granted, free of charge, to any person
obtaining a copy of this software and associated files, subject to conditions:

The above copyright notice and this permission notice shall be included in all
copies. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE for anything."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted.
Redistributions of source code must retain the above copyright notice. Redistributions in binary form
must reproduce the above copyright notice. {} This software is provided by the copyright holders and
contributors "as is"."""


def test_rules_in_order(docs_of):
    cases = {
        1: ("Prose here.\n" + MIT + "\nMore prose.", ["MIT"]),
        2: (BSD.format(""), ["BSD-2-Clause"]),
        3: (BSD.format("The name may not may be used to endorse or promote products derived from this software."), ["BSD-3-Clause"]),
        4: ("x\nLicensed under CC BY-NC 4.0.\ny", ["CC-BY-NC"]),
        5: ("A line without end\nReleased under the MIT License.\nnext", ["MIT"]),
        6: ("This work is licensed under the GNU General Public License, version 3. All rights reserved.", ["GPL-3.0"]),
        7: ("the licence of the author; a copyright notice", []),
        8: (None, []), 9: ("", []),
        10: ("word " * 30000 + ". Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        11: ("Licensed under CC BY 4.0. Licensed under CC BY 4.0.", ["CC-BY"]),
    }
    docs = docs_of(*[(k, t) for k, (t, _) in cases.items()], (11, cases[11][0]), (None, "all rights reserved"))
    docs = docs.withColumn("sentences", F.lit("clash"))
    found = licences.scan(docs).collect()
    assert len(found) == len(cases) + 2
    for r in found:
        assert r["licences"] == (cases[r["key"]][1] if r["key"] else ["proprietary"]), r["key"]
    order = {r["key"]: r["sentences"] for r in found}
    assert order[1] == ["mit_grant", "mit_notice", "as_is", "mit_liability"]
    assert order[6] == ["gpl3_under", "reserved"]
    assert licences.scan(docs.limit(0)).count() == 0


def test_order_matters(docs_of):
    """The sentences of a licence in another order name no licence."""
    sentences = ["The above copyright notice and this permission notice shall be included in all copies.",
                 "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."]
    found = {r["key"]: r["licences"] for r in licences.scan(docs_of((1, " ".join(sentences)), (2, " ".join(sentences[::-1])))).collect()}
    assert found == {1: [], 2: ["MIT"]}


def test_every_sentence_has_an_anchor():
    anchors = licences.anchors(licences.SENTENCES)
    assert all(any(a in text.split() for a in anchors) for text in licences.SENTENCES.values())
    used = {s for r in licences.RULES for s in r.sentences}
    assert used <= set(licences.SENTENCES)


def test_every_sentence_of_a_stretch_counts(docs_of):
    cases = {
        1: ("Licensed under the Apache License, Version 2.0, or under the MIT License, at your option.",
            ["apache_under", "mit_under"], ["Apache-2.0", "MIT"]),
        2: ("Code is released under the MIT License\nText is released under CC BY-SA 4.0",
            ["mit_under", "cc_by_sa_under"], ["MIT", "CC-BY-SA"]),
        3: ("Text is under CC BY-SA 4.0\nPictures are under CC BY 4.0\nCode is under the MIT License",
            ["cc_by_sa_under", "cc_by_under", "mit_under"], ["MIT", "CC-BY-SA", "CC-BY"]),
        4: ("This is free and unencumbered software released into the public domain", ["unlicense"], ["Unlicense"]),
        5: (MIT.replace(".", "").replace(":", ""), ["mit_grant", "mit_notice", "as_is", "mit_liability"], ["MIT"]),
        6: ("May be used to endorse or promote products derived from this software is provided by the copyright holders"
            " and contributors as is", ["bsd_endorse", "bsd_warranty"], []),
        7: ("Under the MIT License\n" * 2, ["mit_under", "mit_under"], ["MIT"]),
        8: ("thunder the mit licenses", [], []),
    }
    for r in licences.scan(docs_of(*[(k, c[0]) for k, c in cases.items()])).collect():
        assert (r["sentences"], r["licences"]) == cases[r["key"]][1:], r["key"]


def test_spdx_tags(docs_of):
    cases = {
        1: ("// SPDX-License-Identifier: Apache-2.0\nint main() {}", ["spdx_apache_2_0"], ["Apache-2.0"]),
        2: ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT */\n# SPDX-License-Identifier: CC-BY-SA-4.0",
            ["spdx_gpl_2_0_only", "spdx", "spdx_mit", "spdx_cc_by_sa_4_0"], ["MIT", "GPL-2.0", "CC-BY-SA"]),
        3: ("SPDX-License-Identifier: MIT-0\nSPDX-License-Identifier:\n", ["spdx", "spdx"], []),
        4: ("SPDX-License-Identifier: GPL-2.0+\nCopyright, all rights reserved", ["spdx_gpl_2_0", "reserved"], ["GPL-2.0"]),
        5: ("this or mit and isc", [], []),
    }
    for r in licences.scan(docs_of(*[(k, c[0]) for k, c in cases.items()])).collect():
        assert (r["sentences"], sorted(r["licences"])) == (cases[r["key"]][1], sorted(cases[r["key"]][2])), r["key"]


GPL_HEADER = """This {kind} is free software{colon} you can redistribute it and/or modify
it under the terms of the GNU {name}General Public License as published by
the Free Software Foundation{end} either version {version} of the License, or
(at your option) any later version.

This {kind} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name}General Public License for more details.

You should have received a copy of the GNU {name}General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
HEADERS = {
    "GPL-3.0": GPL_HEADER.format(kind="program", colon=":", name="", end=",", version="3"),
    "GPL-2.0": GPL_HEADER.format(kind="program", colon=";", name="", end=";", version="2"),
    "LGPL-3.0": GPL_HEADER.format(kind="program", colon=":", name="Lesser ", end=",", version="3"),
    "LGPL-2.1": GPL_HEADER.format(kind="library", colon=";", name="Lesser ", end=";", version="2.1"),
    "AGPL-3.0": GPL_HEADER.format(kind="program", colon=":", name="Affero ", end=",", version="3"),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "ISC": """Copyright (c) 2020, Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES.""",
    "BSD-2-Clause": """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.""",
    "CC0": """To the extent possible under law, the author has waived all copyright
and related or neighboring rights to this work.""",
    "MIT": MIT,
}
HEADERS["BSD-3-Clause"] = HEADERS["BSD-2-Clause"].replace("THIS SOFTWARE IS", """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS""")
TITLES = {
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "GPL-2.0": "GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007",
    "Apache-2.0": "Apache License\nVersion 2.0, January 2004", "MPL-2.0": "Mozilla Public License Version 2.0\n====", "CC0": "CC0 1.0 Universal",
}


def test_file_headers_and_titles_under_any_comment_mark(docs_of):
    """Each names exactly its licence; mentions of other licences in a text name none."""
    marks = ["", "# ", "// ", " * "]
    cases = [(name, "\n".join(mark + line for line in ("prose before.\n" + text).split("\n")))
             for listed in (HEADERS, TITLES) for name, text in listed.items() for mark in marks]
    cases += [("GPL-3.0", TITLES["GPL-3.0"] + "\n\n13. Use with the GNU Affero General Public License.\n\n" + HEADERS["GPL-3.0"]
               + "\n\nIf this is what you want to do, use the GNU Lesser General Public License instead of this License.")]
    found = {r["key"]: r["licences"] for r in licences.scan(docs_of(*enumerate(t for _, t in cases))).collect()}
    assert [(name, found[i]) for i, (name, _) in enumerate(cases)] == [(name, [name]) for name, _ in cases]
