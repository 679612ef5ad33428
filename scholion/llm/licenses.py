"""Licences in texts, by recognising their sentences.

A text is cut into sentences, and each is brought to a normal form: small letters and digits, words
one blank apart, without comment marks and punctuation, and with one wording for "is licensed
under", "released under the terms of" and the like. The normal form is looked up among known
licence sentences, which gives each an identifier; what isn't known is passed over. The
identifiers, in text order, are matched against the licence rules in order: a rule names the
identifiers that must follow one another, and where several rules match, the rule that comes first
takes the identifiers that it covers.

Licences have their SPDX identifiers. A sentence that names a family without a version ("under the
GNU GPL", "under CC BY", "in the public domain") gives ``LicenseRef-`` and the family, and a GNU
version without "only" or "or later" the version alone.

The sentence table is fixed, so it is a constant of the query plan. Only texts that hold a word of
which every known sentence has one are cut up. Everything is DataFrame and SQL functions, without a
shuffle.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm.common import table

# Sentences of licence texts and notices, by identifier.
TEXTS: dict[str, tuple[str, ...]] = {
    "apache_comply": ("you may not use this file except in compliance with the license",),
    "apache_copy": ("you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    "apache_asis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "apache_limits": ("see the license for the specific language governing permissions and limitations under the license",),
    "mit_grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit_notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit_asis": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "isc_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "bsd0_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "bsd_grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd_source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    "bsd_endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "mpl2_form": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "mpl2_copy": ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    "zlib_asis": ("this software is provided as is without any express or implied warranty",),
    "zlib_event": ("in no event will the authors be held liable for any damages arising from the use of this software",),
    "zlib_grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "boost_grant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",),
    "unlicense_free": ("this is free and unencumbered software released into the public domain",),
    "unlicense_anyone": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "cc0_waiver": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",),
    "public_domain": ("released into the public domain", "this work is in the public domain", "this work has been released into the public domain"),
    "reserved": ("all rights reserved",),
    "gnu_even": ("without even the implied warranty of merchantability or fitness for a particular purpose",),
}

# Names of licences, by identifier and licence: as a sentence of their own or after "under", and after "under" only.
NAMES: tuple[tuple[str, str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("mit", "MIT", ("mit license", "mit licence", "expat license"), ()),
    ("apache2", "Apache-2.0", ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache software license version 2 0"), ("apache license version 2 0 the license", "apache 2 0")),
    ("apache", "LicenseRef-Apache", ("apache license", "apache software license"), ()),
    ("isc", "ISC", ("isc license",), ()),
    ("bsd2", "BSD-2-Clause", ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"), ("bsd 2 clause",)),
    ("bsd3", "BSD-3-Clause", ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"), ("bsd 3 clause",)),
    ("bsd0", "0BSD", ("bsd zero clause license", "zero clause bsd license"), ("0bsd",)),
    ("bsd", "LicenseRef-BSD", ("bsd license",), ()),
    ("mpl2", "MPL-2.0", ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mozilla public license v 2 0"), ("mpl 2 0",)),
    ("epl2", "EPL-2.0", ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "eclipse public license v 2 0"), ("epl 2 0",)),
    ("boost", "BSL-1.0", ("boost software license version 1 0", "boost software license 1 0"), ()),
    ("zlib", "Zlib", ("zlib license", "zlib libpng license"), ()),
    ("unlicense", "Unlicense", ("unlicense",), ()),
    ("cc0", "CC0-1.0", ("cc0 1 0 universal", "creative commons zero v1 0 universal", "cc0 1 0 universal public domain dedication"), ("cc0", "cc0 1 0")),
)

# SPDX identifiers that stand after "SPDX-License-Identifier:".
SPDX = "MIT Apache-2.0 ISC BSD-2-Clause BSD-3-Clause 0BSD MPL-2.0 EPL-2.0 BSL-1.0 Zlib Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later".split()

#: GNU licences: the word in the name, the short name, the versions, and what their notices call the work.
_GNU = (("general", "gpl", ("2", "3"), ("program",)), ("lesser general", "lgpl", ("2 1", "3"), ("program", "library")), ("affero general", "agpl", ("3",), ("program",)))
_ENDINGS = {"": ("",), "-only": (" only",), "-or-later": (" or later", " or any later version", " or at your option any later version")}
_CC = {"by": "", "by sa": " sharealike", "by nc": " noncommercial", "by nd": " noderivatives", "by nc sa": " noncommercial sharealike", "by nc nd": " noncommercial noderivatives"}

#: Words with which a sentence says that something is under a licence, and what stands for them in the normal form.
UNDER = "^(?:this (?:work|project|software|program|package|library|file|code|document|text|article|repository) is )?(?:dual |made )?(?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the |a |an )?"
#: Two spellings of words in names.
SPELLINGS = (("share alike", "sharealike"), ("non commercial", "noncommercial"), ("no derivatives", "noderivatives"))


def _canonical(sentence: str) -> str:
    out = re.sub("^the ", "", re.sub(UNDER, "under ", sentence))
    for spelled, word in SPELLINGS:
        out = out.replace(spelled, word)
    return out


def _versioned(short: str, version: str) -> str:
    return f"{short.upper()}-{version.replace(' ', '.') if ' ' in version else version + '.0'}"


def _name(licence: str) -> str:
    return re.sub("[^a-z0-9]", "_", licence.lower())


def _named() -> dict[str, tuple[str, ...]]:
    """Sentences that name a licence, by licence: made by rule."""
    out: dict[str, list[str]] = {}

    def add(licence: str, full: list[str], short: list[str]) -> None:
        out.setdefault(licence, []).extend([*full, *(f"under {x}" for x in (*full, *short))])

    for _, licence, full, short in NAMES:
        add(licence, list(full), list(short))
    for kind, short, versions, _ in _GNU:
        full, brief = f"gnu {kind} public license", (f"gnu {short}", short)
        add(f"LicenseRef-{short.upper()}", [full], list(brief))
        for version in versions:
            numbers = (version, version if " " in version else f"{version} 0")
            for ending, words in _ENDINGS.items():
                said = [f"{between}{n}{x}" for between in (" version ", " v", " v ", " ") for n in numbers for x in words]
                add(_versioned(short, version) + ending, [full + x for x in said], [*(y + x for y in brief for x in said), *(f"{short}v{n}{x}" for n in numbers for x in words)])
    for kind, words in _CC.items():
        for version in ("", "3 0", "4 0"):
            licence = f"{'' if version else 'LicenseRef-'}CC-{kind.upper().replace(' ', '-')}" + (f"-{version.replace(' ', '.')}" if version else "")
            full = f"creative commons attribution{words}" + (f" {version}" if version else "")
            add(licence, [full + x for x in ("", " license", " international", " international license", " unported license", " international public license")], [f"cc {kind} {version}".rstrip()])
    for licence in SPDX:
        out.setdefault(licence, []).append("spdx license identifier " + re.sub("[^a-z0-9]+", " ", licence.lower()))
    return {k: tuple(dict.fromkeys(v)) for k, v in out.items()}


def _notices() -> tuple[dict[str, tuple[str, ...]], list[tuple[str, tuple[str, ...]]]]:
    """Sentences of the notices of GNU licences and rules for them, wherever they have semicolons or commas, longest first."""
    texts, rules = {}, []
    for kind, short, versions, things in _GNU:
        terms = f"you can redistribute it and or modify it under the terms of the gnu {kind} public license as published by the free software foundation"
        for thing in things:
            free, useful, even = f"this {thing} is free software", f"this {thing} is distributed in the hope that it will be useful but without any warranty", TEXTS["gnu_even"][0]
            received = f"you should have received a copy of the gnu {kind} public license along with this {thing}"
            for version in versions:
                either = f"either version {version} of the license or at your option any later version"
                at = version.replace(" ", "_")
                own = {f"{thing}_free": free, f"{short}_terms": terms, f"either_{at}": either, f"{thing}_{short}_terms": f"{free} {terms}", f"{short}_terms_{at}": f"{terms} {either}", f"{thing}_{short}_{at}": f"{free} {terms} {either}"}
                own |= {f"{thing}_useful": useful, f"{thing}_hope": f"{useful} {even}", f"{thing}_{short}_received": received}
                texts |= {k: (v,) for k, v in own.items()}
                grants = ((f"{thing}_{short}_{at}",), (f"{thing}_free", f"{short}_terms", f"either_{at}"), (f"{thing}_free", f"{short}_terms_{at}"), (f"{thing}_{short}_terms", f"either_{at}"))
                rests = ((f"{thing}_useful", "gnu_even", f"{thing}_{short}_received"), (f"{thing}_hope", f"{thing}_{short}_received"), (f"{thing}_useful", "gnu_even"), (f"{thing}_hope",), ())
                rules += [(_versioned(short, version) + "-or-later", (*grant, *rest)) for rest in rests for grant in grants]
    return texts, rules


_NOTICE_TEXTS, _NOTICE_RULES = _notices()
_NAMED = _named()

#: In order of preference: a licence, and identifiers that follow one another. A longer rule stands before the rules that it contains.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache_2_0", "apache_comply", "apache_copy", "apache_asis", "apache_limits")),
    ("Apache-2.0", ("apache_2_0", "apache_comply", "apache_copy")),
    ("MIT", ("mit", "mit_grant", "mit_notice", "mit_asis")),
    ("MIT", ("mit_grant", "mit_notice", "mit_asis")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("ISC", ("isc", "isc_grant")),
    ("ISC", ("isc_grant",)),
    ("0BSD", ("0bsd", "bsd0_grant")),
    ("0BSD", ("bsd0_grant",)),
    ("Zlib", ("zlib_asis", "zlib_event", "zlib_grant")),
    ("Zlib", ("zlib_grant",)),
    ("BSL-1.0", ("bsl_1_0", "boost_grant")),
    ("BSL-1.0", ("boost_grant",)),
    ("MPL-2.0", ("mpl2_form", "mpl2_copy")),
    ("MPL-2.0", ("mpl2_form",)),
    ("Unlicense", ("unlicense_free", "unlicense_anyone")),
    ("Unlicense", ("unlicense_free",)),
    ("CC0-1.0", ("cc0_waiver",)),
    *_NOTICE_RULES,
    *((licence, (_name(licence),)) for licence in _NAMED),
    ("LicenseRef-Public-Domain", ("public_domain",)),
    ("All-Rights-Reserved", ("reserved",)),
)

#: Every known sentence holds one of these words (a test holds the table to it), in any case. A word is never wrapped.
HINT = r"licen[sc]|permission|permitted|redistribut|software|warrant|domain|rights|waived|liable|copyright|creative|\bcc|\b[al]?gpl|\b[em]pl\b|\b0?bsd|apache"
_BLANKS = r"[ \t\n\x0B\f\r]"
#: The end of a line and the comment mark that may open the next.
_WRAP = r"[ \t]*\n[ \t]*(?:[#*]|//|--)?[ \t]*"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@cache
def known() -> dict[str, str]:
    """The identifier of each known sentence in normal form."""
    out = {_canonical(form): name for name, forms in {**_NOTICE_TEXTS, **TEXTS}.items() for form in forms}
    return out | {_canonical(form): _name(licence) for licence, forms in _NAMED.items() for form in forms}


#: Replacements, one after the other, after which a sentence ends at each line end. Wrapped lines are joined, comment
#: marks aside: a line that goes on with a small letter, or, after a letter or comma, with a word in capitals, or within
#: the name of a licence; an SPDX identifier is a sentence of its own. Then the stop of "v. 2.0" goes, and other stops and
#: semicolons before white space become line ends. Joins that share a word with the one before need a second turn.
STEPS = (
    (r"SPDX(-License-Identifier:[^\n]*)", r". Spdx\1."),
    (_WRAP + r"([a-z(\"])", r" \1"),
    *[(r"([A-Za-z,])" + _WRAP + "([A-Z]{4,})", r"\1 \2")] * 2,
    *[("(GNU|General|Lesser|Affero|Mozilla|Public|Free)" + _WRAP + "(General|Lesser|Affero|Public|License|Software)", r"\1 \2")] * 2,
    (r"(^|[^A-Za-z0-9])([vV])[.]", r"\1\2"),
    (r"[.;]" + _BLANKS, r"\n"),
)


def normal(sentence: Column) -> Column:
    """The normal form of a sentence."""
    out = F.trim(F.regexp_replace(F.translate(sentence, _UPPER, _UPPER.lower()), "[^a-z0-9]+", " "))
    out = F.regexp_replace(F.regexp_replace(out, UNDER, "under "), "^the ", "")
    for spelled, word in SPELLINGS:
        out = F.replace(out, F.lit(spelled), F.lit(word))
    return out


def sentences(text: Column) -> Column:
    """Sentences in normal form, in order, without empty ones."""
    out = F.concat(text, F.lit(" "))
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by.replace("\\n", "\n").replace("\\1", "$1").replace("\\2", "$2"))
    return F.filter(F.transform(F.split(out, "\n", -1), normal), lambda x: x != "")


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order; none for null."""
    table = F.create_map(*(F.lit(x) for pair in known().items() for x in pair))
    found = F.filter(F.transform(sentences(text), lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull())
    return F.when(text.rlike(f"(?i){HINT}"), found).otherwise(F.array().cast("array<string>"))


def licences_of(names: Column) -> Column:
    """``array<struct<at, licence>>``: what the rules find in identifiers, in order; ``at`` counts identifiers from 0.

    From left to right, the first rule in order that matches takes the identifiers that it names.
    """
    line = F.array_join(F.transform(names, lambda x, k: F.concat(k.cast("string"), F.lit(":"), x, F.lit("|"))), "")
    pattern = "|".join("".join(rf"[0-9]+:{x}\|" for x in rule) for _, rule in RULES)
    licences = {"".join(f"{y}|" for y in rule): licence for licence, rule in reversed(RULES)}
    licence_of = F.create_map(*(F.lit(x) for pair in licences.items() for x in pair))

    def named(hit: Column) -> Column:
        rule = F.regexp_replace(hit, "[0-9]+:", "")
        return F.struct(F.regexp_extract(hit, "^([0-9]+):", 1).cast("int").alias("at"), F.element_at(licence_of, rule).alias("licence"))

    hits = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    return F.when(F.size(names) > 0, F.transform(hits, named)).otherwise(F.array().cast("array<struct<at:int,licence:string>>"))


def scan_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, ``identifiers`` of the known sentences in order, and ``found``, what the rules made of them.

    Null and empty texts have none. Repeated rows get equal results; an empty table gives an empty
    result; columns other than the two named are ignored, so none can clash. Whole texts are read.
    """
    kept = docs.select(F.col(id_col).alias("id"), identifiers(F.coalesce(F.col(text_col), F.lit(""))).alias("identifiers"))
    return kept.select(F.col("id").alias(id_col), "identifiers", licences_of(F.col("identifiers")).alias("found"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"))
    licences = F.array_distinct(F.transform("found", lambda x: x["licence"]))
    return found.select("doc_id", F.concat_ws(",", licences).alias("licenses"), F.concat_ws(",", "identifiers").alias("sentences"), F.size("identifiers").cast("long").alias("n_sentences"), F.size("found").cast("long").alias("n_found"))


def _op1_sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    text = "coalesce(text, '') || ' '"
    for pattern, by in STEPS:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(by).replace(chr(92) + 'n', chr(10))}, 'g')"
    plain = f"trim(regexp_replace(translate(s, '{_UPPER}', '{_UPPER.lower()}'), '[^a-z0-9]+', ' ', 'g'))"
    plain = f"regexp_replace(regexp_replace({plain}, {quoted(UNDER)}, 'under '), '^the ', '')"
    for spelled, word in SPELLINGS:
        plain = f"replace({plain}, '{spelled}', '{word}')"
    rows = ", ".join(f"({quoted(form)}, {quoted(name)})" for form, name in known().items())
    licences = {"".join(f"{x}|" for x in rule): licence for licence, rule in reversed(RULES)}
    rules = ", ".join(f"({quoted(rule)}, {quoted(licence)})" for rule, licence in licences.items())
    pattern = "|".join("".join(rf"[0-9]+:{x}\|" for x in rule) for _, rule in RULES)
    return f"""WITH
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
s AS (SELECT r, generate_subscripts(x, 1) AS place, unnest(x) AS s FROM (SELECT r, string_split({text}, chr(10)) AS x FROM d)),
n AS (SELECT r, place, {plain} AS form FROM s),
known(form, name) AS (VALUES {rows}),
i AS (SELECT r, name, row_number() OVER (PARTITION BY r ORDER BY place) - 1 AS k FROM n JOIN known USING (form)),
l AS (SELECT r, string_agg(k || ':' || name || '|', '' ORDER BY k) AS line, string_agg(name, ',' ORDER BY k) AS sentences, count(*) AS n_sentences FROM i GROUP BY r),
rules(rule, licence) AS (VALUES {rules}),
h AS (SELECT r, generate_subscripts(x, 1) AS place, unnest(x) AS hit FROM (SELECT r, regexp_extract_all(line, {quoted(pattern)}) AS x FROM l)),
f AS (SELECT r, licence, min(place) AS place, count(*) AS n FROM h JOIN rules ON rule = regexp_replace(hit, '[0-9]+:', '', 'g') GROUP BY r, licence),
g AS (SELECT r, string_agg(licence, ',' ORDER BY place) AS licenses, CAST(sum(n) AS BIGINT) AS n_found FROM f GROUP BY r)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(sentences, '') AS sentences, CAST(coalesce(n_sentences, 0) AS BIGINT) AS n_sentences, CAST(coalesce(n_found, 0) AS BIGINT) AS n_found
FROM d LEFT JOIN l USING (r) LEFT JOIN g USING (r)"""


OP1_SQL = _op1_sql()
