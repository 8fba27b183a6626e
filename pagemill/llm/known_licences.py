"""Known licence texts: whole bodies in licence_texts, and the headers and lines that name one.

Each is a fixed value; the variants of a body differ in what people leave out of it (title,
preface, appendix) and in how they mark its clauses.
"""

from __future__ import annotations

import re
from pathlib import Path

FOLDER = Path(__file__).parent / "licence_texts"
APPENDIX = re.compile(r"(?im)^[ \t]*(?:APPENDIX: How to apply|How to Apply These Terms|Exhibit [AB]\b|ADDENDUM: How to use).*\Z", re.DOTALL)
END = re.compile(r"(?im)^[ \t]*END OF TERMS AND CONDITIONS[ \t]*$")
MARKER = re.compile(r"(?m)^[ \t]*(?:[0-9]+\.|\*|-|\(?[a-d]\))[ \t]+")

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
APACHE_TERMS = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
ASF = """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file
distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to {} under the Apache
License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at {}mozilla.org/MPL/2.0/."""
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BY = "This work is licensed under {} Creative Commons {} 4.0 International License."
VISIT = "To view a copy of this license, visit http://creativecommons.org/licenses/{}/4.0/"
LETTER = " or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."


def gnu_headers() -> list[tuple[str, str]]:
    """Headers of the GNU licences: only one version or later ones, with and without what follows."""
    out = []
    for licence, full, version in (
        ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"),
        ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"),
        ("AGPL-3.0", "GNU Affero General Public License", "3"),
    ):
        for work in ("program", "library", "file", "software"):
            for which in (f"either version {version} of the License, or (at your option) any later version.", f"version {version} of the License."):
                grant = f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {full} as published by the Free Software Foundation, {which}"
                warranty = f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {full} for more details."
                copy = f"You should have received a copy of the {full} along with this {work}. If not, see <http://www.gnu.org/licenses/>."
                out += [(licence, grant), (licence, f"{grant} {warranty}"), (licence, f"{grant} {warranty} {copy}")]
    return out


HEADERS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", APACHE),
    ("Apache-2.0", f"{APACHE} {APACHE_TERMS}"),
    *(("Apache-2.0", f"{ASF.format(whom)} {APACHE_TERMS}") for whom in ("you", "You")),
    # The sentence stands in all BSD licences.
    ("BSD", BSD),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "This software is released under the MIT License."),
    *(("MPL-2.0", MPL.format(place)) for place in ("http://", "https://www.")),
    *(
        (name, f"{BY.format(article, words)}{more}")
        for name, words, path in (("CC-BY-4.0", "Attribution", "by"), ("CC-BY-NC-4.0", "Attribution-NonCommercial", "by-nc"), ("CC-BY-SA-4.0", "Attribution-ShareAlike", "by-sa"))
        for article in ("a", "the")
        for more in ("", f" {VISIT.format(path)}.", f" {VISIT.format(path)}{LETTER}")
    ),
    *gnu_headers(),
    *(
        (name.split(" ")[0], f"SPDX-License-Identifier: {name.replace(' ', '')}")
        for name in (
            "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "ISC", "MIT", "MPL-2.0",
            *(f"{x} {y}" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for y in ("", "-only", "-or-later")),
        )
    ),
)


def bodies() -> list[tuple[str, str]]:
    """Whole licences with their variants."""
    out = []
    for path in sorted(FOLDER.glob("*.txt")):
        text = path.read_text()
        cuts = {text, APPENDIX.sub("", text)}
        cuts |= {c[: m.start()] for c in cuts if (m := END.search(c))} | {c[: m.end()] for c in cuts if (m := END.search(c))}
        if path.stem in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"):
            cuts |= {c.replace("\nAll rights reserved.\n", "\n") for c in cuts}
            cuts |= {c.split("\n", 1)[1] for c in cuts} | {re.sub(r"\A", "The ", c) for c in cuts}
            cuts |= {c[m.start() :] for c in cuts if (m := re.search(r"(?m)^(?:Permission|Redistribution and use)", c))}
            cuts |= {MARKER.sub("", c) for c in cuts}
            cuts |= {c.replace("name of the copyright holder nor", "name of the <organization> nor".replace("<organization>", o)) for c in cuts for o in ("author", "organization")}
        out += [(path.stem, c) for c in sorted(cuts)]
    return out
