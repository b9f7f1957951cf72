"""Licence scan by canonical digests.

A text is brought to canonical form (lower case, copyright lines removed, punctuation and blanks reduced to
single spaces, equivalent spellings unified) and hashed whole; the digests are joined with those of known
licences, which go through the same function. Single lines and paragraphs are looked up the same way among known
notices. Spellings of two words are unified for the lookup only; text_digest is that of the form with single words.

Cases: null and empty texts, and texts that are empty in canonical form, match nothing (digest null). Long
texts are one row. Repeated rows each get a result. Two known names with equal digests: the smaller name is
reported. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that licence matching treats as equal.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "sublicence": "sublicense", "sublicenced": "sublicensed",
    "sublicences": "sublicenses", "maximise": "maximize", "modelled": "modeled",
    "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while",
    "wilful": "wilfull",
}

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE."
)
# Whole texts of known licences.
LICENSES = {
    "MIT": (
        "MIT License\n\nCopyright (c) <year> <copyright holders>\n\nPermission is hereby granted, free of charge, to any "
        'person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "ISC License\n\nCopyright (c) <year> <owner>\n\nPermission to use, copy, modify, and/or distribute this software "
        "for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.\n\n" + _AS_IS
    ),
    "0BSD": (
        "BSD Zero Clause License\n\nCopyright (c) <year> <owner>\n\nPermission to use, copy, modify, and/or distribute this "
        "software for any purpose with or without fee is hereby granted.\n\n" + _AS_IS
    ),
}
# One-line notices and the licence they name.
NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "SPDX-License-Identifier: MIT": "MIT",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0",
}
# First paragraphs of notices of several lines.
_GNU = (
    "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published "
    "by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
)
HEADERS = {
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
    "License. You may obtain a copy of the License at": "Apache-2.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
    "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.": "MPL-2.0",
} | {
    _GNU.format(what=what, name=name, version=version): license
    for what in ("program", "library")
    for name, version, license in (
        ("General Public License", "1", "GPL-1.0"), ("General Public License", "2", "GPL-2.0"), ("General Public License", "3", "GPL-3.0"),
        ("Library General Public License", "2", "LGPL-2.0"), ("Lesser General Public License", "2.1", "LGPL-2.1"),
        ("Lesser General Public License", "3", "LGPL-3.0"), ("Affero General Public License", "3", "AGPL-3.0"),
    )
}
# Spellings of two words that count as one; the first words, the second ones and what stands for them.
TWO_WORDS = {
    "sub licen[sc]e": "sublicense", "sub licen[sc]ed": "sublicensed", "sub licensing": "sublicensing", "non commercial": "noncommercial", "per cent": "percent",
    "copyright owner": "copyright holder", "copyright owners": "copyright holders",
}
TWO_WORDS_AT_ALL = "\\b(?:sub licen|non commercial|per cent|copyright owner)"
TERMS_END = "END OF TERMS AND CONDITIONS"
# A line is a copyright line if a year, a sign, a placeholder or "by" follows, if it ends in a kind of holder, or if a single word
# follows; other lines that begin with the word belong to a clause ("copyright notice and this permission notice appear").
_HOLDER_KINDS = "inc|llc|ltd|gmbh|corp|corporation|company|authors|contributors|developers|maintainers|foundation|project|team|others"
_FOLLOWS = "[ \\t:,]*(?:\\(c\\)|©|&copy;|[0-9]{4}|<|\\[|\\{|by )"
COPYRIGHT_LINE = (
    f"(?m)^[ \\t#*/;-]*(?:copyrights?(?:{_FOLLOWS}[^\\n]*|[^\\n]* (?:{_HOLDER_KINDS})[.]?|[ \\t]+[^ \\t\\n.,;:]+)[ \\t]*$"
    "|\\(c\\)[ \\t]*(?:[0-9]{4}|<|\\[|copyright)[^\\n]*$|\\(c\\)(?:[ \\t]+[^ \\t\\n]+){1,4}[ \\t]*$|©[^\\n]*$|all rights reserved[^\\n]*$)"
)
NOT_WORD = "[^\\p{L}\\p{N}]+"
NOT_WORD_OR_END = "[^\\p{L}\\p{N}\\n]+"
#: Known tables up to so many rows are broadcast (32 hex digits and a name each); larger ones are shuffled.
BROADCAST_ROWS = 100_000


def _spelling_pattern() -> str:
    """One alternative per first letter keeps the scan of texts that hold none of the words short."""
    heads: dict[str, list[str]] = {}
    for word in sorted(SPELLINGS):
        heads.setdefault(word[0], []).append(word[1:])
    return "\\b(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in heads.items()) + ")\\b"


def canonical_lines(text: Column) -> Column:
    """Canonical form of a text, line by line ('' if nothing is left)."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    marked = lower.contains("copyright") | lower.contains("(c)") | lower.contains("©") | lower.contains("all rights reserved")
    rest = F.when(marked, F.regexp_replace(lower, COPYRIGHT_LINE, " ")).otherwise(lower)
    plain = F.regexp_replace(rest, NOT_WORD_OR_END, " ")
    spelling = F.create_map(*[F.lit(w) for pair in SPELLINGS.items() for w in pair])
    unify = lambda line: F.array_join(F.transform(F.split(line, " "), lambda w: F.coalesce(F.element_at(spelling, w), w)), " ")
    unified = F.array_join(F.transform(F.split(plain, "\n"), unify), "\n")
    return F.when(plain.rlike(_spelling_pattern()), unified).otherwise(plain)


def one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, " ?\\n[ \\n]*", " "))


def _digest_of(form: Column) -> Column:
    return F.when(form != "", F.md5(form.cast("binary")))


def digest(text: Column) -> Column:
    return _digest_of(one_line(canonical_lines(text)))


def one_word(form: Column) -> Column:
    """A canonical form with spellings of two words made one."""
    made = form
    for two, one in TWO_WORDS.items():
        made = F.regexp_replace(made, f"\\b{two}\\b", one)
    return F.when(form.rlike(TWO_WORDS_AT_ALL), made).otherwise(form)


def full_licenses(spark) -> DataFrame:
    """(license, text) of LICENSES and of the texts in license_texts (NAME.txt or NAME@VARIANT.txt), each also as it is
    without its title, if its copyright line follows that, and without what stands behind its terms."""
    found = [(n, t) for n, t in LICENSES.items()]
    for file in (resources.files(__package__) / "license_texts").iterdir():
        if file.name.endswith(".txt"):
            found.append((file.name.removesuffix(".txt").split("@")[0], file.read_text("utf-8")))
    for name, text in list(found):
        title, _, rest = text.strip().partition("\n\n")
        if rest.startswith("Copyright (c) <"):
            found.append((name, rest))
        if TERMS_END in text:
            found.append((name, text[: text.index(TERMS_END) + len(TERMS_END)]))
    found += [(n, f"The {n} License ({n})\n\n" + LICENSES[n].partition("\n\n")[2]) for n in ("MIT", "ISC")]
    return spark.createDataFrame(sorted(set(found)), "license string, text string")


def full_notices(spark) -> DataFrame:
    """(license, text) of NOTICES and HEADERS."""
    return built_in(spark, NOTICES | HEADERS)


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license) of known(license, text), one row a digest."""
    return known.select(_digest_of(one_word(one_line(canonical_lines(F.col("text"))))).alias("digest"), "license").filter("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))


def built_in(spark, table: dict[str, str]) -> DataFrame:
    """A fixed table of texts and licence names as a DataFrame without Python on the executors."""
    pairs = F.array(*[F.struct(F.lit(text).alias("text"), F.lit(name).alias("license")) for text, name in table.items()])
    return spark.range(1).select(F.inline(pairs))


def _bounded(known: DataFrame) -> DataFrame:
    return F.broadcast(known) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else known


def scan(df: DataFrame, licenses: DataFrame | None = None, notices: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_digest, license (of the whole text, else null) and notices (names found on lines or paragraphs, sorted).

    licenses and notices: (license, text); the built-in tables if not given.
    """
    spark = df.sparkSession
    licenses = built_in(spark, {t: n for n, t in LICENSES.items()}) if licenses is None else licenses
    notices = built_in(spark, NOTICES) if notices is None else notices
    rows = df.select(key, text)
    known = known_digests(licenses).select("digest", F.lit(True).alias("whole"), "license")
    known = _bounded(known.unionByName(known_digests(notices).select("digest", F.lit(False).alias("whole"), "license")))
    # one pass over the texts: the digest of the whole and those of its lines and paragraphs, of which only hits go on
    forms = rows.select(key, F.monotonically_increasing_id().alias("_row"), canonical_lines(F.col(text)).alias("_form"))
    forms = forms.select(key, "_row", one_line(F.col("_form")).alias("_line"), one_word(F.col("_form")).alias("_form"))
    unit = lambda whole, form, shown: F.struct(F.lit(whole).alias("whole"), _digest_of(form).alias("digest"), shown.alias("shown"))
    whole = F.array(unit(True, one_word(F.col("_line")), _digest_of(F.col("_line"))))
    lines = F.transform(F.split("_form", "\n"), lambda x: unit(False, F.trim(x), F.lit(None).cast("string")))
    blocks = F.filter(F.split("_form", "\n ?\n[ \n]*"), lambda x: x.contains("\n"))
    blocks = F.transform(blocks, lambda x: unit(False, one_word(one_line(x)), F.lit(None).cast("string")))
    units = forms.select(key, "_row", F.inline(F.concat(whole, lines, blocks)))
    found = units.join(known, ["digest", "whole"], "left").filter(F.col("whole") | F.col("license").isNotNull())
    of_whole, of_line = F.when(F.col("whole"), F.col("license")), F.when(~F.col("whole"), F.col("license"))
    grouped = found.groupBy(key, "_row").agg(
        F.max("shown").alias("text_digest"), F.max(of_whole).alias("license"),
        F.array_join(F.array_sort(F.collect_set(of_line)), ",").alias("notices"),
    )
    return grouped.drop("_row")
