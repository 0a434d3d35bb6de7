"""Licence scans by sentence rules.

A text is cut into sentences; a normalised sentence (lower case, runs of other characters than
letters and digits as one space) becomes the identifiers of the known licence sentences it holds,
in the order of their places; one that lies inside a longer one does not count.  The text's
identifiers, in order, are then held against the licence rules: in the order of the list, each rule whose identifiers occur in a row names its
licence and takes those identifiers away, so that a whole licence goes before its parts.  Reserved
rights alone count as ``proprietary``.

All of it is done by column functions within the row, in one pass without a shuffle.  Sentences
are cut only in texts that hold one of the anchors, words of which every known sentence has one.

Defined cases: a null or empty text names nothing; repeated rows give a row each; a null key stays
null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import let, text_of

# Normalised licence sentences.
SENTENCES = {
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies",
    "as_is": "the software is provided as is without warranty of any kind",
    "mit_liability": "in no event shall the authors or copyright holders be liable",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose",
    "isc_grant_old": "permission to use copy modify and distribute this software for any purpose",
    "isc_notice": "provided that the above copyright notice and this permission notice appear in all copies",
    "isc_as_is": "the software is provided as is and the author disclaims all warranties",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd_source": "redistributions of source code must retain the above copyright notice",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice",
    "bsd_endorse": "may be used to endorse or promote products derived from this software",
    "bsd_warranty": "this software is provided by the copyright holders and contributors as is",
    "apache_under": "licensed under the apache license version 2 0",
    "apache_use": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "apache_basis": "distributed under the license is distributed on an as is basis",
    "apache_text": "apache license version 2 0 january 2004",
    "gpl_free": "this program is free software you can redistribute it and or modify it",
    "lib_free": "this library is free software you can redistribute it and or modify it",
    "gpl_terms": "under the terms of the gnu general public license as published by the free software foundation",
    "lgpl_terms": "under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl_terms": "under the terms of the gnu affero general public license as published by the free software foundation",
    "version_3": "either version 3 of the license",
    "version_2": "either version 2 of the license",
    "version_2_1": "either version 2 1 of the license",
    "gpl_hope": "this program is distributed in the hope that it will be useful",
    "gpl_copy": "you should have received a copy of the gnu general public license",
    "gpl3_text": "gnu general public license version 3 29 june 2007",
    "gpl2_text": "gnu general public license version 2 june 1991",
    "lgpl3_text": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21_text": "gnu lesser general public license version 2 1 february 1999",
    "agpl3_text": "gnu affero general public license version 3 19 november 2007",
    "gpl3_under": "licensed under the gnu general public license version 3",
    "gpl2_under": "licensed under the gnu general public license version 2",
    "lgpl_under": "licensed under the gnu lesser general public license",
    "agpl_under": "licensed under the gnu affero general public license",
    "mpl_under": "subject to the terms of the mozilla public license v 2 0",
    "mpl_text": "mozilla public license version 2 0",
    "mit_under": "under the mit license",
    "bsd_under": "under the bsd license",
    "cc0_under": "under cc0",
    "cc0_text": "cc0 1 0 universal",
    "cc0_waived": "has waived all copyright and related or neighboring rights",
    "cc_by_nc_nd_under": "under cc by nc nd",
    "cc_by_nc_sa_under": "under cc by nc sa",
    "cc_by_nc_under": "under cc by nc",
    "cc_by_nd_under": "under cc by nd",
    "cc_by_sa_under": "under cc by sa",
    "cc_by_under": "under cc by",
    "cc_deed": "licensed under a creative commons attribution",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "public_domain": "released into the public domain",
    "spdx": "spdx license identifier",
    "reserved": "all rights reserved",
}


@dataclass(frozen=True)
class Rule:
    licence: str
    sentences: tuple[str, ...]


# Rules from the longest to the shortest.
RULES = (
    Rule("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_warranty")),
    Rule("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_warranty")),
    Rule("MIT", ("mit_grant", "mit_notice", "as_is", "mit_liability")),
    Rule("Apache-2.0", ("apache_under", "apache_use", "apache_copy", "apache_basis")),
    Rule("GPL-3.0", ("gpl_free", "gpl_terms", "version_3", "gpl_hope", "gpl_copy")),
    Rule("GPL-2.0", ("gpl_free", "gpl_terms", "version_2", "gpl_hope", "gpl_copy")),
    Rule("MIT", ("mit_grant", "mit_notice", "as_is")),
    Rule("ISC", ("isc_grant", "isc_notice", "isc_as_is")),
    Rule("ISC", ("isc_grant_old", "isc_notice", "isc_as_is")),
    Rule("GPL-3.0", ("gpl_free", "gpl_terms", "version_3")),
    Rule("GPL-2.0", ("gpl_free", "gpl_terms", "version_2")),
    Rule("LGPL-3.0", ("gpl_free", "lgpl_terms", "version_3")),
    Rule("LGPL-3.0", ("lib_free", "lgpl_terms", "version_3")),
    Rule("LGPL-2.1", ("lib_free", "lgpl_terms", "version_2_1")),
    Rule("LGPL-2.1", ("gpl_free", "lgpl_terms", "version_2_1")),
    Rule("AGPL-3.0", ("gpl_free", "agpl_terms", "version_3")),
    Rule("ISC", ("isc_grant", "as_is")),
    Rule("MIT", ("mit_grant", "mit_notice")),
    Rule("Apache-2.0", ("apache_under",)),
    Rule("Apache-2.0", ("apache_text",)),
    Rule("GPL-3.0", ("gpl3_text",)),
    Rule("GPL-2.0", ("gpl2_text",)),
    Rule("LGPL-3.0", ("lgpl3_text",)),
    Rule("LGPL-2.1", ("lgpl21_text",)),
    Rule("AGPL-3.0", ("agpl3_text",)),
    Rule("GPL-3.0", ("gpl3_under",)),
    Rule("GPL-2.0", ("gpl2_under",)),
    Rule("LGPL", ("lgpl_under",)),
    Rule("AGPL", ("agpl_under",)),
    Rule("MPL-2.0", ("mpl_under",)),
    Rule("MPL-2.0", ("mpl_text",)),
    Rule("MIT", ("mit_under",)),
    Rule("BSD", ("bsd_under",)),
    Rule("CC0", ("cc0_under",)),
    Rule("CC0", ("cc0_text",)),
    Rule("CC0", ("cc0_waived",)),
    Rule("CC-BY-NC-ND", ("cc_by_nc_nd_under",)),
    Rule("CC-BY-NC-SA", ("cc_by_nc_sa_under",)),
    Rule("CC-BY-NC", ("cc_by_nc_under",)),
    Rule("CC-BY-ND", ("cc_by_nd_under",)),
    Rule("CC-BY-SA", ("cc_by_sa_under",)),
    Rule("CC-BY", ("cc_by_under",)),
    Rule("CC", ("cc_deed",)),
    Rule("Unlicense", ("unlicense",)),
    Rule("public domain", ("public_domain",)),
    Rule("proprietary", ("reserved",)),
)
# Counts only where nothing else is named: "All rights reserved." opens many a free licence.
LAST_RESORT = "proprietary"

# Licences by the ids of SPDX tags.
SPDX = {
    "mit": "MIT", "isc": "ISC", "apache-2.0": "Apache-2.0", "bsd-2-clause": "BSD-2-Clause", "bsd-3-clause": "BSD-3-Clause",
    "mpl-2.0": "MPL-2.0", "cc0-1.0": "CC0", "unlicense": "Unlicense",
    **{f"{kind}gpl-{version}{end}": f"{kind.upper()}GPL-{version}"
       for kind, versions in (("", ("2.0", "3.0")), ("l", ("2.0", "2.1", "3.0")), ("a", ("3.0",)))
       for version in versions for end in ("", "-only", "-or-later")},
    **{f"cc-{kind}-{version}": f"CC-{kind.upper()}" for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
       for version in ("1.0", "2.0", "2.5", "3.0", "4.0")},
}
SPDX_SENTENCES = {"spdx_" + re.sub("[^a-z0-9]", "_", i): f"spdx license identifier {re.sub('[^a-z0-9]', ' ', i)} spdx" for i in SPDX}
SPDX_RULES = tuple(Rule(licence, (name,)) for name, licence in zip(SPDX_SENTENCES, SPDX.values()))
# Each id of a tag, also behind an operator, becomes a sentence of its own, closed by a word.
TAG = r"(?:spdx-license-identifier[ \t]*:[ \t(]*|\G(?!^)[ \t()]+(?:or|and|with)[ \t()]+)([a-z0-9][a-z0-9.+-]*)"
TAGGED = ". spdx-license-identifier $1 spdx. "

# Sentences end at a full stop, question or exclamation mark with white space behind, or at an empty
# line; not behind a letter or digit that stands alone ("v. 2.0", "1. Definitions").
ALONE = (r"(^|[ \t\r\n(])([a-z0-9])\.([ \t])", r"$1$2 $3")
BREAK = r"[.!?]+[ \t\r]*\n|[.!?]+[ \t]+|\n[ \t\r]*\n"


def anchors(sentences: dict[str, str]) -> list[str]:
    """Few words of which every sentence holds one: again and again the word in most sentences
    not yet covered, longer words first among equals."""
    left, chosen = {name: set(s.split()) for name, s in sentences.items()}, []
    while left:
        words = {w for held in left.values() for w in held}
        best = max(words, key=lambda w: (sum(w in held for held in left.values()) * min(len(w), 6), len(w), w))
        chosen.append(best)
        left = {name: held for name, held in left.items() if best not in held}
    return chosen


def heads(sentences: dict[str, str]) -> dict[str, tuple[str, str]]:
    """Each sentence as a head and a tail, the longest end with which another sentence begins.

    Searching goes on behind the head, so that the other is found though it shares the tail.  Where
    two sentences have one head, they are taken whole, and of the other the first hit counts alone.
    """
    def cut(words):
        for n in range(1, len(words)):
            tail = " ".join(words[n:])
            if any(other.startswith(tail + " ") for other in sentences.values()):
                return " ".join(words[:n]), tail
        return " ".join(words), ""

    parts = {name: cut(text.split()) for name, text in sentences.items()}
    times = Counter(head for head, _ in parts.values())
    return {name: (head, tail) if times[head] == 1 else (sentences[name], "") for name, (head, tail) in parts.items()}


def identifiers(text: Column, sentences: dict[str, str] = SENTENCES | SPDX_SENTENCES) -> Column:
    """The identifiers of a text's known sentences, in order."""
    tagged = F.regexp_replace(F.regexp_replace(F.lower(text), TAG, TAGGED), *ALONE)
    normal = F.transform(F.split(tagged, BREAK, -1), lambda s: F.concat(
        F.lit(" "), F.regexp_replace(s, "[^a-z0-9]+", " "), F.lit(" ")))
    parts = heads(sentences)
    name_of = {head: name for name, (head, _) in parts.items()}
    assert len(name_of) == len(sentences)
    # Of those that begin at a place the longest is tried first.
    longest_first = sorted(sentences, key=lambda name: -len(sentences[name]))
    known = "|".join(parts[n][0] + (f"(?= {parts[n][1]} )" if parts[n][1] else "(?= )") for n in longest_first)
    names = F.create_map(*[F.lit(x) for pair in name_of.items() for x in pair])
    found = F.flatten(F.transform(normal, lambda s: F.regexp_extract_all(s, F.lit(f"(?<= )({known})"), F.lit(1))))

    held = reduce(Column.__or__, [F.lower(text).contains(a) for a in anchors(sentences)])
    return F.when(held, F.transform(found, lambda s: names[s])).otherwise(F.array().cast("array<string>"))


def named(found: Column, rules: tuple[Rule, ...] = RULES + SPDX_RULES) -> Column:
    """Licences named by a sequence of identifiers, in the order of the rules."""
    for part in {s for r in rules for s in r.sentences}:
        assert re.fullmatch("[a-z0-9_]+", part)
    # Each identifier stands between blanks of its own, so that neighbours can be matched in a row.
    sequence = F.array_join(F.transform(found, lambda s: F.concat(F.lit("<"), s, F.lit(">"))), "")
    table = F.array(*[F.struct(F.lit(r.licence).alias("licence"),
                               F.lit("".join(f"<{s}>" for s in r.sentences)).alias("row")) for r in rules])

    def apply(state, rule):
        hit = state["left"].contains(rule["row"])
        return F.struct(F.when(hit, F.replace(state["left"], rule["row"], F.lit("|"))).otherwise(state["left"]).alias("left"),
                        F.when(hit, F.concat(state["found"], F.array(rule["licence"]))).otherwise(state["found"]).alias("found"))

    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("found"))
    def sure(licences: Column) -> Column:
        others = F.array_remove(licences, LAST_RESORT)
        return F.when(F.size(others) > 0, others).otherwise(licences)

    return let(F.aggregate(table, start, apply), lambda s: let(F.array_distinct(s["found"]), sure))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key, sentences array, licences array``."""
    read = docs.select(F.col(key).alias("key"), identifiers(text_of(text)).alias("sentences"))
    found = F.when(F.size("sentences") > 0, named(F.col("sentences"))).otherwise(F.array().cast("array<string>"))
    return read.withColumn("licences", found)
