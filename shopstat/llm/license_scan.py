"""License scan by sentence rules (operator 7, DataFrame functions only).

A text is normalised (lower case, everything but letters and digits to one
space).  Sentences begin and end at ``. ; : ! ?`` before a space or line end,
at blank lines and at the ends of the text, and may also begin or end at any
other line end and at a comma; a line break or comma inside a sentence counts
as a space, the colon of an SPDX tag ends nothing, and comment leaders without
letters (``#``, ``*``, ``//``) vanish.  So wrapped and commented
sentences are known as well as one-line notices without a full stop; of two
known sentences that begin at one place the longer counts.
The identifiers found, in text order, form a sequence; the ordered rules
are tried one after the other, each takes every place where its sequence of
identifiers stands (other known sentences between them end the match), and
what a rule took is not offered to later rules.  So the full text of a
licence is reported once and not also as its opening line.

Everything happens inside the row (no shuffle): the tables of sentences and
rules are parameters (a few hundred entries at most; ``SENTENCES`` and
``RULES`` by default), and one pattern of all sentences replaces a join.

Defined results: one row per document; null or empty text, or no known
sentence: no licences, empty sequence; a licence found twice is listed once,
in rule order; ``unmatched`` counts known sentences that no rule took;
repeated rows are scanned one by one; a null id stays null; very long texts are
scanned whole; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopstat.llm.common import let

# Sentences of public licences in normalised form (a trailing * takes any
# continuation, for names and years), and the identifier of each.
SENTENCES = [
    ("released under the mit license", "MitLine"),
    ("licensed under the mit license", "MitLine"),
    ("this project is licensed under the mit license", "MitLine"),
    ("the mit license mit", "MitLine"),
    ("mit license", "MitLine"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction*", "MitGrant"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "MitNotice"),
    ("the software is provided as is without warranty of any kind express or implied*", "AsIs"),
    ("in no event shall the authors or copyright holders be liable for any claim damages or other liability*", "NoLiability"),
    ("licensed under the apache license version 2 0", "ApacheLine"),
    ("licensed under the apache license version 2 0 the license", "ApacheHead"),
    ("you may not use this file except in compliance with the license", "ApacheComply"),
    ("you may obtain a copy of the license at", "ApacheCopy"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis*", "ApacheBasis"),
    ("see the license for the specific language governing permissions and limitations under the license", "ApacheSee"),
    ("this work is licensed under the gnu general public license version 3", "Gpl3Line"),
    ("licensed under the gnu general public license version 3", "Gpl3Line"),
    ("this program is free software", "GplFree"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation*", "GplTerms"),
    ("either version 3 of the license or at your option any later version", "Gpl3Later"),
    ("either version 2 of the license or at your option any later version", "Gpl2Later"),
    ("this program is distributed in the hope that it will be useful but without any warranty*", "GplHope"),
    ("see the gnu general public license for more details", "GplSee"),
    ("licensed under cc by nc 4 0", "CcByNcLine"),
    ("licensed under cc by 4 0", "CcByLine"),
    ("licensed under cc by sa 4 0", "CcBySaLine"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "CcByLine"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "BsdGrant"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "BsdSource"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation*", "BsdBinary"),
    ("neither the name of*", "BsdName"),
    ("this software is provided by the copyright holders and contributors as is and any express or implied warranties*", "BsdAsIs"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted*", "IscGrant"),
    ("the software is provided as is and the author disclaims all warranties*", "IscAsIs"),
    ("this is free and unencumbered software released into the public domain", "Unlicense"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "Mpl2Line"),
    ("this source code form is subject to the terms of the mozilla public license v", "Mpl2Line"),
    ("this library is free software", "LgplFree"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation*", "LgplTerms"),
    ("either version 2 1 of the license or at your option any later version", "Lgpl21Later"),
    ("this library is distributed in the hope that it will be useful but without any warranty*", "LgplHope"),
    ("see the gnu lesser general public license for more details", "LgplSee"),
    ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation*", "AgplTerms"),
    ("see the gnu affero general public license for more details", "AgplSee"),
]

# SPDX identifiers whose tag line is known.
SPDX = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
        "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC",
        "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]
SENTENCES += [("spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower()), f"Tag{i}") for i, name in enumerate(SPDX)]

# Rules in the order they are tried; a ? marks an optional sentence.
RULES = [
    ("MIT", ["MitLine?", "MitGrant", "MitNotice", "AsIs", "NoLiability"]),
    ("MIT", ["MitLine?", "MitGrant", "MitNotice?"]),
    ("Apache-2.0", ["ApacheHead", "ApacheComply", "ApacheCopy", "ApacheBasis", "ApacheSee"]),
    ("Apache-2.0", ["ApacheHead", "ApacheComply?", "ApacheCopy?"]),
    ("LGPL-2.1-or-later", ["LgplFree?", "GplFree?", "LgplTerms", "Lgpl21Later", "LgplHope?", "GplHope?", "LgplSee?"]),
    ("LGPL-3.0-or-later", ["LgplFree?", "GplFree?", "LgplTerms", "Gpl3Later", "LgplHope?", "GplHope?", "LgplSee?"]),
    ("AGPL-3.0-or-later", ["GplFree?", "AgplTerms", "Gpl3Later", "GplHope?", "AgplSee?"]),
    ("GPL-3.0-or-later", ["GplFree", "GplTerms", "Gpl3Later", "GplHope", "GplSee?"]),
    ("GPL-2.0-or-later", ["GplFree", "GplTerms", "Gpl2Later", "GplHope", "GplSee?"]),
    ("GPL-3.0-or-later", ["GplTerms", "Gpl3Later"]),
    ("GPL-2.0-or-later", ["GplTerms", "Gpl2Later"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdName", "BsdAsIs?"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs?"]),
    ("ISC", ["IscGrant", "IscAsIs?"]),
    ("MIT", ["MitLine"]), ("Apache-2.0", ["ApacheLine"]), ("GPL-3.0", ["Gpl3Line"]),
    ("CC-BY-NC-4.0", ["CcByNcLine"]), ("CC-BY-4.0", ["CcByLine"]), ("CC-BY-SA-4.0", ["CcBySaLine"]),
    ("Unlicense", ["Unlicense"]), ("MPL-2.0", ["Mpl2Line"]),
]
RULES += [(name, [f"Tag{i}"]) for i, name in enumerate(SPDX)]

# A text without any of these can't hold a known sentence; skipping it changes no result.
HINT = r"(?i)licen[sc]e|permission|software|redistribut|warrant|liab|public domain|neither the name"


def normalised(text: Column) -> Column:
    """Letters and digits of a text with single spaces; ``.`` where a sentence
    surely ends, ``|`` at other line ends."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\x01\x02]", " "), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(spdx-license-identifier):", "$1 ")
    t = F.regexp_replace(t, r",(?=[ \t\n])", "\x02")
    t = F.regexp_replace(t, r"(?<=[.;:!?])[ \t]+|(?<=[.;:!?])\n|(?<=\n)[^\p{L}\p{N}\n]*+\n", "\x01")
    t = F.regexp_replace(F.regexp_replace(t, r"\n", "\x02"), r"[^\p{L}\p{N}\x01\x02]+", " ")
    t = F.regexp_replace(t, r"[ \x01\x02]*\x01[ \x01\x02]*", ".")
    return F.trim(F.regexp_replace(t, r" ?(?:\x02 ?)+", "|"))


Table = list[tuple[str, str]]


def _any(table: Table) -> str:
    """Every known sentence, longest first, where one may begin and (unless it goes on) end."""
    return r"(?<![^.|])(?:" + "|".join(
        t.rstrip("*").replace(" ", "[ |]") + ("" if t.endswith("*") else r"(?![^.|])")
        for t, _ in sorted(table, key=lambda e: -len(e[0]))) + ")"


def sentences(text: Column, table: Table = SENTENCES) -> Column:
    """The known sentences of a text in order."""
    found = F.regexp_extract_all(normalised(text), F.lit(_any(table)), F.lit(0))
    return F.transform(found, lambda s: F.replace(s, F.lit("|"), F.lit(" ")))


def _known(s: Column, table: Table) -> Column:
    exact = [(t, i) for t, i in table if not t.endswith("*")]
    found = reduce(lambda acc, name: acc.when(s.isin([t for t, i in exact if i == name]), name),
                   dict.fromkeys(i for _, i in exact), F.when(F.lit(False), F.lit(None).cast("string")))
    for t, name in table:
        if t.endswith("*"):
            found = found.when(s.startswith(t[:-1]), name)
    return found


def _rule_pattern(rule: list[str]) -> str:
    """Identifiers stand as ``<Name>``; a rule is a pattern over them."""
    return "".join(f"(?:<{r[:-1]}>)?" if r.endswith("?") else f"<{r}>" for r in rule)


def scan_licenses(docs: DataFrame, table: Table = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, hint: str | None = HINT) -> DataFrame:
    """``doc_id``, ``licenses`` (comma-joined), ``sentence_ids`` (the sequence),
    ``n_known`` and ``unmatched`` of every document.  ``table`` holds
    normalised sentences with their identifiers, ``rules`` names with
    sequences of identifiers, ``hint`` a pattern without which a text can't
    hold a sentence of the table (None: every text is cut up)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = F.filter(F.transform(sentences(text, table), lambda s: _known(s, table)), lambda i: i.isNotNull())
    if hint:
        ids = F.when(text.rlike(hint), ids).otherwise(F.array().cast("array<string>"))
    found = docs.select("doc_id", ids.alias("_ids"))

    def tried(seq: Column) -> Column:
        """Apply the rules in order: (what is left, licences found)."""
        state = F.struct(seq.alias("left"), F.array().cast("array<string>").alias("found"))
        tries = F.array(*[F.struct(F.lit(_rule_pattern(r)).alias("p"), F.lit(name).alias("name")) for name, r in rules])
        return F.aggregate(tries, state, lambda acc, r: F.when(
            F.regexp_like(acc["left"], r["p"]),
            F.struct(F.regexp_replace(acc["left"], r["p"], F.lit("#")).alias("left"),
                     F.array_union(acc["found"], F.array(r["name"])).alias("found"))).otherwise(acc))

    seq = F.concat(F.lit(""), *[F.array_join(F.transform("_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")])
    done = found.select("doc_id", "_ids", F.when(F.size("_ids") > 0, tried(seq)).alias("_r"))
    return done.select(
        "doc_id",
        F.coalesce(F.array_join("_r.found", ","), F.lit("")).alias("licenses"),
        F.array_join("_ids", ",").alias("sentence_ids"),
        F.size("_ids").cast("bigint").alias("n_known"),
        F.coalesce(F.length(F.regexp_replace("_r.left", "[^<]", "")), F.lit(0)).cast("bigint").alias("unmatched"))
