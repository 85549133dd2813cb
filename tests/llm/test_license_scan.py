import re

from shopstat.llm import license_scan as L
from tests.llm.helpers import SF, clashing, edge_docs

MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including the rights to use it.
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.
In no event shall the authors or copyright holders be liable for any claim, damages or other liability."""


def pieces(text):
    """Words of a text as ``(word, hard, soft)``: whether a sentence must or may begin at it."""
    text = re.sub(r"(?i)(spdx-license-identifier):", r"\1 ", re.sub(r"\r\n?", "\n", text or "")).lower()
    out, hard, soft = [], True, True
    lines = text.split("\n")
    for line in lines:
        if not re.search(r"[^\W_]", line):
            hard = hard or line is not lines[-1]
            continue
        for m in re.finditer(r"([^\W_]+)|([.;:!?](?=[ \t]|$))|(,(?=[ \t]|$))", line):
            if m[1]:
                out.append((m[1], hard, soft))
                hard = soft = False
            elif m[2]:
                hard = True
            else:
                soft = True
        soft = True
    return out


def known_sentences(text):
    """From each place where a sentence may begin, the longest known one."""
    p, ids, i = pieces(text), [], 0
    table = sorted(((t.rstrip("*").split(), t.endswith("*"), name) for t, name in L.SENTENCES), key=lambda e: -len(" ".join(e[0])))
    while i < len(p):
        hit = None
        if p[i][1] or p[i][2]:
            for words, open_end, name in table:
                n = len(words)
                here = [w for w, _, _ in p[i:i + n]]
                if open_end:            # the last word may go on
                    fits = here[:-1] == words[:-1] and len(here) == n and here[-1].startswith(words[-1])
                else:
                    fits = here == words and (i + n == len(p) or p[i + n][1] or p[i + n][2])
                if fits and not any(h for _, h, _ in p[i + 1:i + n]):
                    hit = (n, name)
                    break
        if hit:
            ids.append(hit[1])
        i += hit[0] if hit else 1
    return ids


def brute(text):
    """The same recognition, one word and one rule at a time."""
    ids = known_sentences(text)
    left, found = "".join(f"<{i}>" for i in ids), []
    for name, rule in L.RULES:
        p = "".join(f"(?:<{r[:-1]}>)?" if r.endswith("?") else f"<{r}>" for r in rule)
        if re.search(p, left):
            left = re.sub(p, "#", left)
            found += [name] if name not in found else []
    return ",".join(found), ",".join(ids), len(ids), left.count("<")


TEXTS = [MIT, "Released under the MIT License.", "x\nLicensed under CC BY-NC 4.0.\ny", MIT + "\nLicensed under the Apache License, Version 2.0.",
         "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n",
         "Released under the MIT License. Released under the MIT License.", "The license of the land", "neither the name of X nor Y",
         "this license is fine. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. end", None, ""]


def _rows(df):
    return {r.doc_id: tuple(r[1:]) for r in L.scan_licenses(df).collect()}


def test_rules_match_brute_force(spark):
    got = _rows(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)], edge_docs(spark).schema))
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert got[0][0] == "MIT" and got[0][3] == 0          # the whole text is one licence, opening line included
    assert got[3][0] == "MIT,Apache-2.0"


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert _rows(docs) == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_edges(spark):
    assert L.scan_licenses(clashing(edge_docs(spark))).count() == edge_docs(spark).count()
    assert L.scan_licenses(edge_docs(spark).limit(0)).collect() == []
    plan = L.scan_licenses(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


APACHE = """Copyright 2020 Somebody
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES.
See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty.
See the GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.
* Neither the name of X nor Y may be used.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
ISC = """Copyright (c) 2020 Somebody
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the notice appears.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES."""


def test_wrapped_and_commented_texts(spark):
    """A text wrapped at any width, commented or not, is known as the unwrapped one."""
    import textwrap
    texts, want = [], []
    for text, name, ids in ((MIT, "MIT", 5), (APACHE, "Apache-2.0", 5), (GPL, "GPL-3.0-or-later", 5), (BSD, "BSD-3-Clause", 5), (ISC, "ISC", 2)):
        for width in (40, 72, 78):
            for leader in ("", "# ", " * ", "// "):
                for end in ("\n", "\r\n"):
                    lines = [x for line in text.split("\n") for x in (textwrap.wrap(line, width) or [""])]
                    texts.append("".join(f"{leader}{x}".rstrip() + end for x in lines))
                    want.append((name, ids))
    got = _rows(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], edge_docs(spark).schema))
    for i, (name, ids) in enumerate(want):
        assert (got[i][0], got[i][2], got[i][3]) == (name, ids, 0), (texts[i], got[i])
    more = ["MIT License\nPermission is hereby granted, free of charge, to any\nperson", "mit\n\nlicense", "released\nunder the MIT\nLicense\nfoo"]
    got = _rows(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(more)], edge_docs(spark).schema))
    assert got[0][0] == "MIT" and got[1][0] == "" and got[2][1] == "MitLine"


# Notices as their licences publish them.
GPL2 = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""
AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
NOTICES = [(GPL2, "GPL-2.0-or-later"), (LGPL, "LGPL-2.1-or-later"), (LGPL.replace("version 2.1", "version 3"), "LGPL-3.0-or-later"),
           (AGPL, "AGPL-3.0-or-later"), (MPL, "MPL-2.0"), (GPL, "GPL-3.0-or-later"), (BSD, "BSD-3-Clause"), (MIT, "MIT"), (ISC, "ISC"), (APACHE, "Apache-2.0")]


def test_published_notices(spark):
    """Plain, wrapped and commented."""
    import textwrap
    texts, want = [], []
    for text, name in NOTICES:
        texts.append(text)
        want.append(name)
        for width in (60, 76):
            for leader in ("", "# ", " * ", "// "):
                lines = [x for line in text.split("\n") for x in (textwrap.wrap(line, width) or [""])]
                texts.append("".join(f"{leader}{x}".rstrip() + "\n" for x in lines) + "int main() { return 0; }\n")
                want.append(name)
    got = _rows(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], edge_docs(spark).schema))
    assert [got[i][0] for i in range(len(texts))] == want
    assert all(got[i] == brute(t) for i, t in enumerate(texts))


def test_tag_lines(spark):
    texts = [f"{lead}SPDX-License-Identifier: {name}{tail}" for name in L.SPDX for lead, tail in
             (("", ""), ("// ", "\n\n#include <a.h>"), ("# ", "\nimport os"), ("/* ", " */\n"))]
    got = _rows(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], edge_docs(spark).schema))
    assert [got[i][0] for i in range(len(texts))] == [name for name in L.SPDX for _ in range(4)]


def test_tables_are_parameters(spark):
    docs = spark.createDataFrame([(1, "You may dance. Nobody may sing.", "en", "s", 1)], edge_docs(spark).schema)
    table, rules = [("you may dance", "Dance"), ("nobody may*", "Sing")], [("Ballroom-1.0", ["Dance", "Sing"])]
    row, = L.scan_licenses(docs, table, rules, hint=None).collect()
    assert (row.licenses, row.sentence_ids, row.unmatched) == ("Ballroom-1.0", "Dance,Sing", 0)
