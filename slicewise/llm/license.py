"""Licence recognition by sentence rules.

Text is cut into sentences, each sentence is normalised and mapped to the identifiers of the known
licence sentences in it, and the sequence of identifiers is matched against ordered licence rules.
Lines that were wrapped are joined and comment marks go first: a sentence ends at a blank line, or
at a full stop, question or exclamation mark with a blank behind it. A rule takes its sentences
out of the sequence, so a weaker rule further down cannot claim them again. One projection of
built-in functions: no shuffle, whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise.llm.common import ascii_lower

#: Fixed values. A sentence without any of these is not looked at.
KEYWORDS = (r"licen[cs]e|copyright|spdx|public domain|creative commons|cc by|cc0|redistribut|"
            r"permission|warrant|software is provided|endorse|gnu |unencumbered software")

#: Fixed values. Identifier of a sentence, and the pattern its normalised form holds. Of identifiers
#: that are alternatives (``family``) a sentence has the first that it holds.
SENTENCES = [
    ("SPDX-Apache-2.0", r"spdx license identifier apache 2 0"),
    ("SPDX-MIT", r"spdx license identifier mit\b"),
    ("SPDX-BSD-3", r"spdx license identifier bsd 3 clause"),
    ("SPDX-BSD-2", r"spdx license identifier bsd 2 clause"),
    ("SPDX-GPL-2", r"spdx license identifier gpl 2 0"),
    ("SPDX-GPL-3", r"spdx license identifier gpl 3 0"),
    ("SPDX-MPL-2", r"spdx license identifier mpl 2 0"),
    ("ApacheRef2", r"\blicensed under (?:the )?apache license,? (?:version )?2(?: 0)?\b"),
    ("ApacheCopy", r"\byou may obtain a copy of the license at\b"),
    ("ApacheUse", r"\byou may not use this file except in compliance with the license\b"),
    ("ApacheAsIs", r"\bdistributed under the license is distributed on an as is basis\b"),
    ("MITRef", r"\b(?:released|licensed|available|distributed) under (?:the )?mit license\b"),
    ("MITPermission", r"\bpermission is hereby granted free of charge to any person obtaining a copy\b"),
    ("MITNotice", r"\bthe above copyright notice and this permission notice shall be included\b"),
    ("MITWarranty", r"\bthe software is provided as is without warranty of any kind\b"),
    ("BSDPermission", r"\bredistribution and use in source and binary forms with or without modification are permitted\b"),
    ("BSDSource", r"\bredistributions of source code must retain\b"),
    ("BSDBinary", r"\bredistributions in binary form must reproduce\b"),
    ("BSDEndorse", r"\bneither the names? of .* may be used to endorse\b"),
    ("BSDWarranty", r"\bthis software is provided by .* as is\b"),
    ("AGPLRef3", r"\bgnu affero general public license (?:as published .* )?version 3\b"),
    ("LGPLRef3", r"\bgnu lesser general public license (?:as published .* )?version 3\b"),
    ("LGPLRef21", r"\bgnu lesser general public license (?:as published .* )?version 2 1\b"),
    ("GPLRef3", r"\bgnu general public license (?:as published .* )?(?:version |v)3\b"),
    ("GPLRef2", r"\bgnu general public license (?:as published .* )?(?:version |v)2\b"),
    ("GPLLater", r"\bany later version\b"),
    ("GPLWarranty", r"\bwithout even the implied warranty of merchantability\b"),
    ("MPLRef2", r"\bmozilla public license,? (?:version |v) ?2 0\b"),
    ("CC0", r"\bcc0\b|\bcreative commons zero\b"),
    ("CCBYNCND", r"\bcc by nc nd\b|\battribution noncommercial noderivs\b"),
    ("CCBYNCSA", r"\bcc by nc sa\b|\battribution noncommercial sharealike\b"),
    ("CCBYNC", r"\bcc by nc\b|\battribution noncommercial\b"),
    ("CCBYSA", r"\bcc by sa\b|\battribution sharealike\b"),
    ("CCBY", r"\bcc by\b|\bcreative commons attribution\b"),
    ("PublicDomain", r"\b(?:in|into) the public domain\b"),
    ("ISCPermission", r"\bpermission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted\b"),
    ("Unlicense", r"\bfree and unencumbered software released into the public domain\b"),
    ("EPLRef2", r"\beclipse public license,? (?:version |v) ?2 0\b"),
    ("Copyright", r"\bcopyright (?:c )?[12][0-9]{3}\b"),
    ("AllRights", r"\ball rights reserved\b"),
]
_GPL = ("AGPLRef", "LGPLRef", "GPLRef")


def family(name: str) -> str:
    """What the identifier is an alternative in; most stand alone."""
    if name.startswith(_GPL):
        return "GPLRef"
    return next((f for f in ("SPDX", "CC") if name.startswith(f)), name)


def families() -> dict[str, list[tuple[str, str]]]:
    """The sentence patterns by family, in order."""
    out: dict[str, list[tuple[str, str]]] = {}
    for name, pattern in SENTENCES:
        out.setdefault(family(name), []).append((name, pattern))
    return out


#: Fixed values. Marks of comments and quotations at the beginning of a line; the end of a sentence.
COMMENT = r"\n[ \t\r]*(?:(?://+|/\*+|\*+/?|#+|;+|--+|>+|<!--+)[ \t\r]*)?"
END = r"\n\n+|[.!?][\x22')]*[ \t\r]*\n|[.!?][\x22')]*[ \t\r]+"

#: Fixed values. Rules in order; a sequence is written as ``|id|id|``.
RULES = [
    ("Apache-2.0", r"\|ApacheRef2\|(?:ApacheUse\|)?(?:ApacheCopy\|)?(?:ApacheAsIs\|)?|\|SPDX-Apache-2\.0\|"),
    ("BSD-3-Clause", r"\|BSDPermission\|BSDSource\|BSDBinary\|BSDEndorse\|(?:BSDWarranty\|)?|\|SPDX-BSD-3\|"),
    ("BSD-2-Clause", r"\|BSDPermission\|BSDSource\|BSDBinary\|(?:BSDWarranty\|)?|\|SPDX-BSD-2\|"),
    ("MIT", r"\|MITPermission\|(?:MITNotice\|)?(?:MITWarranty\|)?|\|MITRef\||\|SPDX-MIT\|"),
    ("AGPL-3.0", r"\|AGPLRef3\|(?:GPLLater\|)?(?:GPLWarranty\|)?"),
    ("LGPL-3.0", r"\|LGPLRef3\|(?:GPLLater\|)?(?:GPLWarranty\|)?"),
    ("LGPL-2.1", r"\|LGPLRef21\|(?:GPLLater\|)?(?:GPLWarranty\|)?"),
    ("GPL-3.0-or-later", r"\|GPLRef3\|GPLLater\|(?:GPLWarranty\|)?"),
    ("GPL-3.0", r"\|GPLRef3\|(?:GPLWarranty\|)?|\|SPDX-GPL-3\|"),
    ("GPL-2.0-or-later", r"\|GPLRef2\|GPLLater\|(?:GPLWarranty\|)?"),
    ("GPL-2.0", r"\|GPLRef2\|(?:GPLWarranty\|)?|\|SPDX-GPL-2\|"),
    ("MPL-2.0", r"\|MPLRef2\||\|SPDX-MPL-2\|"),
    ("CC0-1.0", r"\|CC0\|"),
    ("CC-BY-NC-ND", r"\|CCBYNCND\|"),
    ("CC-BY-NC-SA", r"\|CCBYNCSA\|"),
    ("CC-BY-NC", r"\|CCBYNC\|"),
    ("CC-BY-SA", r"\|CCBYSA\|"),
    ("CC-BY", r"\|CCBY\|"),
    ("ISC", r"\|ISCPermission\|(?:MITWarranty\|)?"),
    ("EPL-2.0", r"\|EPLRef2\|"),
    ("Unlicense", r"\|(?:PublicDomain\|)?Unlicense\|"),
    ("public-domain", r"\|PublicDomain\|"),
    ("proprietary", r"\|(?:Copyright\|)?AllRights\|"),
]
UNKNOWN = "?"


def _sentences(text: Column) -> Column:
    """Normalised sentences that hold a keyword: lower case, words of letters and digits only."""
    lines = F.regexp_replace(F.concat(F.lit("\n"), ascii_lower(text)), COMMENT, "\n")
    parts = F.split(F.regexp_replace(lines, END, "\u0001"), "\u0001")
    clean = F.transform(parts, lambda s: F.btrim(F.regexp_replace(s, r"[^\x{80}-\x{10FFFF}0-9a-z]+", " ")))
    return F.filter(clean, lambda s: s.rlike(KEYWORDS))


def _identifiers(sentence: Column) -> Column:
    each = []
    for rules in families().values():
        known = F.when(F.lit(False), F.lit(""))
        for name, pattern in rules:
            known = known.when(sentence.rlike(pattern), F.lit(name))
        each.append(known)
    return F.array_compact(F.array(*each))


def scan_expression(text: Column) -> Column:
    """Struct of ``ids`` (identifiers in order, ``?`` for a licence-like sentence that is not
    known) and ``licenses`` (names in the order of the rules)."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<string>")
    likely = text.rlike(f"(?i){KEYWORDS.replace(' ', '[^0-9a-z]+')}")
    of = lambda s: F.transform(F.array(_identifiers(s)), lambda i: F.when(
        F.size(i) > 0, i).otherwise(F.array(F.lit(UNKNOWN))))[0]
    ids = F.when(likely, F.flatten(F.transform(_sentences(text), of))).otherwise(none)
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in RULES])

    def match(acc: Column, rule: Column) -> Column:
        hit = F.regexp_like(acc["seq"], rule["pattern"])
        return F.struct(
            F.when(hit, F.regexp_replace(acc["seq"], rule["pattern"], F.lit("|"))
                   ).otherwise(acc["seq"]).alias("seq"),
            F.when(hit, F.array_append(acc["names"], rule["name"])).otherwise(acc["names"]).alias("names"))

    def licences(found: Column) -> Column:
        seq = F.concat(F.lit("|"), F.array_join(found, "|"), F.lit("|"))
        return F.aggregate(rules, F.struct(seq.alias("seq"), none.alias("names")), match,
                           lambda acc: acc["names"])

    return F.transform(F.array(ids), lambda found: F.struct(
        found.alias("ids"),
        F.when(F.size(found) > 0, licences(found)).otherwise(none).alias("licenses")))[0]


def scan(docs: DataFrame, text: str = "text", into: str = "license") -> DataFrame:
    """``docs`` with the struct of ``scan_expression`` in ``into`` (replacing such a column).

    One row in, one row out. Null and empty texts have no sentences and no licence; texts of any
    length are read whole; repeated rows and other columns stay as they are.
    """
    return docs.withColumn(into, scan_expression(F.col(text)))


def digest(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", scan_expression(F.col("text")).alias("found"))
    known = F.size(F.filter("found.ids", lambda x: x != UNKNOWN))
    return found.select(
        "doc_id", known.cast("long").alias("n_known"),
        (F.size("found.ids") - known).cast("long").alias("n_unknown"),
        F.array_join("found.ids", ",").alias("sentence_ids"),
        F.array_join("found.licenses", ",").alias("licenses"))
