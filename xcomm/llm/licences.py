"""Licence scan by sentence rules (DataFrame operations only).

Texts are normalised to words and break marks, so that sentences stay whole where lines are wrapped
or commented out.  Known licence sentences are found in them by one expression and mapped to
identifiers; the sequence of identifiers of a document is then matched against ordered rules.  The
sentence table and the rules are fixed lists, so both are literals of the plan: no join, no
shuffle, every row on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised licence sentences by identifier; ``*`` stands for one to ten words.
SENTENCES = {
    "mit_ref": ["released under the mit license", "licensed under the mit license", "this software is released under the mit license"],
    "mit_name": ["mit license", "the mit license", "the mit license mit"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
                   "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"],
    "as_is": ["the software is provided as is without warranty of any kind express or implied"],
    "apache2_ref": ["licensed under the apache license version 2.0", "released under the apache license version 2.0", "licensed under the apache license version 2.0 the license"],
    "apache2_name": ["apache license version 2.0", "apache license", "apache license version 2.0 january 2004"],
    "apache2_terms": ["terms and conditions for use reproduction and distribution"],
    "apache2_comply": ["you may not use this file except in compliance with the license"],
    "gpl3_ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl_name": ["gnu general public license"],
    "gpl3_title": ["gnu general public license version 3 29 june 2007"],
    "gpl3_preamble": ["the gnu general public license is a free copyleft license for software and other kinds of works"],
    "gpl_redistribute": ["free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
                         "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license"],
    "bsd_redistribute": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_notice": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_endorse": ["neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "cc_by_nc4_ref": ["licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0"],
    "cc_by4_ref": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0"],
    "cc0_ref": ["this work is dedicated to the public domain", "released under cc0 1.0"],
    "reserved": ["all rights reserved"],
}
#: Sentences of the licence texts themselves: they count inside longer sentences, too.  The others are
#: names and references, which a further word can turn into something else.
INSIDE = {
    "mit_grant", "mit_notice", "as_is", "apache2_comply", "gpl3_preamble", "gpl_redistribute", "bsd_redistribute", "bsd_notice", "bsd_endorse",
}
#: Ordered rules, each a sequence of identifiers that must appear in this order (other
#: identifiers may stand between them).  A rule only counts when no earlier rule of the same licence
#: matched; rules are ordered from the most to the least specific.
RULES = [
    ("MIT", "full", ["mit_grant", "mit_notice", "as_is"]),
    ("MIT", "titled", ["mit_name", "mit_grant"]),
    ("MIT", "reference", ["mit_ref"]),
    ("Apache-2.0", "full", ["apache2_name", "apache2_terms"]),
    ("Apache-2.0", "notice", ["apache2_ref", "apache2_comply"]),
    ("Apache-2.0", "titled", ["apache2_name", "apache2_comply"]),
    ("Apache-2.0", "reference", ["apache2_ref"]),
    ("GPL-3.0", "full", ["gpl3_title", "gpl3_preamble"]),
    ("GPL-3.0", "notice", ["gpl_redistribute"]),
    ("GPL-3.0", "reference", ["gpl3_ref"]),
    ("BSD-3-Clause", "full", ["bsd_redistribute", "bsd_notice", "bsd_endorse"]),
    ("BSD-2-Clause", "full", ["bsd_redistribute", "bsd_notice"]),
    ("CC-BY-NC-4.0", "reference", ["cc_by_nc4_ref"]),
    ("CC-BY-4.0", "reference", ["cc_by4_ref"]),
    ("CC0-1.0", "reference", ["cc0_ref"]),
    ("proprietary", "reference", ["reserved"]),
]
#: Only texts with one of these can have a known sentence; the others skip normalisation.
HINT = r"(?i)licen|permission|permitted|copyright|warranty|redistribut|dedicated|cc0|reserved|terms"
#: Any run of spaces, line ends and semicolons between two words of a sentence.
BETWEEN = "[ VW]+"


def normalised(text: Column) -> Column:
    """Lower case; everything but letters, digits and dots inside numbers becomes one space, and
    breaks become capitals without spaces around them: ``S`` a stop that white space follows or a
    line without words, ``W`` another line break, ``V`` a semicolon.  Marks of comments before a
    line go, too."""
    text = F.regexp_replace(F.lower(text), r"[.!?](?=[\x20\x09-\x0D]|\z)", "S")
    text = F.regexp_replace(text, ";", "V")
    text = F.regexp_replace(text, r"(?:\r\n?|\n|\A)(?:[\x20\x09]*(?:dnl|rem)(?![a-z0-9]))?", "W")
    text = F.regexp_replace(text, r"[^a-z0-9.SVW]+", " ")
    text = F.regexp_replace(text, r"\.(?![a-z0-9])|(?<![a-z0-9])\.", " ")
    text = F.regexp_replace(text, r"W[ V]*W[ VW]*", "S")
    return F.regexp_replace(F.regexp_replace(text, " +", " "), " ?([SVW]) ?", "$1")


def _pattern(sentence: str) -> str:
    word = "[a-z0-9.]+"
    any_words = f"{word}(?:{BETWEEN}{word}){{0,9}}?"
    return BETWEEN.join(any_words if w == "*" else w.replace(".", r"\.") for w in sentence.split(" "))


def _known() -> str:
    """An expression for all known sentences, longer ones first."""
    every = sorted(((s, i) for i, group in SENTENCES.items() for s in group), key=lambda x: (-len(x[0]), x[0]))
    whole = "|".join(_pattern(s) for s, i in every if i not in INSIDE)
    inside = "|".join(_pattern(s) for s, i in every if i in INSIDE)
    return f"(?<![a-z0-9.])(?:{inside})(?![a-z0-9]|\\.[a-z0-9])|(?<![^SVW])(?:{whole})(?![^SVW])"


def licence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    plain = [(s, i) for i, group in SENTENCES.items() for s in group if "*" not in s]
    table = F.create_map(*[F.lit(x) for pair in plain for x in pair])

    def identifier(found: Column) -> Column:
        found = F.regexp_replace(found, BETWEEN, " ")
        wide = [F.when(found.rlike(f"^(?:{_pattern(s)})$"), F.lit(i)) for i, group in SENTENCES.items() for s in group if "*" in s]
        return F.coalesce(F.try_element_at(table, found), *wide)

    found = F.transform(F.regexp_extract_all(normalised(text), F.lit(_known()), F.lit(0)), identifier)
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def scan_licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """Licences of every document.

    Returns ``row`` (struct of all columns), ``sentence_ids`` (array, in order), ``licences``
    (array of distinct licence names in rule order), ``rules`` (array of ``licence:rule``) and
    ``n_known`` (known sentences, repeats counted).  After normalisation a sentence of a licence's
    own text (``INSIDE``) is known wherever it stands; names and references are known when they are
    a whole sentence, line or part up to a semicolon.  Lines may be wrapped anywhere between words
    and commented out; sentences do not go on after an empty line.  Null and empty texts have no sentences; equal rows get equal
    results; an empty table gives an empty result; columns of any name travel in ``row``.
    """
    found = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), licence_ids(F.col(text)).alias("sentence_ids")
    ).withColumn("_line", F.concat(F.lit(" "), F.array_join("sentence_ids", " "), F.lit(" ")))
    matches, seen = [], {}
    for licence, rule, ids in RULES:
        hit = F.col("_line").rlike(".* ".join(f" {i}" for i in ids).replace(".*  ", "(?: .*)? ") + " ")
        earlier = seen.get(licence)
        matches.append(F.when(hit & ~earlier if earlier is not None else hit, F.lit(f"{licence}:{rule}")))
        seen[licence] = hit if earlier is None else earlier | hit
    # two-clause text is part of the three-clause one
    rules = F.array_compact(F.array(*matches))
    rules = F.when(F.array_contains(rules, "BSD-3-Clause:full"), F.array_remove(rules, "BSD-2-Clause:full")).otherwise(rules)
    out = found.withColumn("rules", rules)
    return out.select(
        "row",
        "sentence_ids",
        F.array_distinct(F.transform("rules", lambda r: F.substring_index(r, ":", 1))).alias("licences"),
        "rules",
        F.size("sentence_ids").cast("long").alias("n_known"),
    )
