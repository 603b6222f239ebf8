"""Licence recognition by sentence rules.

A text is normalised as a whole (lower case, letters and digits only); line ends and sentence ends stay as marks between its
words.  A known licence sentence starts and ends at such marks and may hold any of them, so it is found on one line, wrapped
or in a commented block, and whether or not it holds a colon, a semicolon or "v. 2.0".  Each is replaced by its identifier;
version numbers are parameters of an identifier,
and so is the expression of an SPDX line that has no sentence of its own (words joined by full stops; it ends
with its line).  Licence rules
are sequences of identifiers, tried in order: where a rule's sequence stands in the text's identifier sequence, those
identifiers are used up and the licence is reported, so a long rule goes before the rules whose sentences it contains.
Known sentences that no rule used are reported as ``Unmatched``.

Everything is DataFrame expressions on the text's own row: no shuffle, no row is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences after normalisation, as patterns ("#" stands for a version number).
SENTENCES = [
    ("spdx-apache-2.0", "spdx license identifier apache 2 0"),
    ("spdx-mit", "spdx license identifier mit"),
    ("spdx-gpl", "spdx license identifier gpl # (only|or later)"),
    ("spdx-bsd-3", "spdx license identifier bsd 3 clause"),
    ("apache-named", "(this (work|file|software|document|text) is )?licensed under the apache license version #( the license)?"),
    ("apache-obey", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at( http www apache org licenses license 2 0)?"),
    ("apache-asis", "unless required by applicable law or agreed to in writing software distributed under the license is "
                    "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit-named", "((this (work|file|software|document|text) is )?(released|licensed|distributed) under( the terms of)? the mit license|"
                  "(the )?mit license)"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                  "documentation files the software to deal in the software without restriction .*"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial "
                   "portions of the software"),
    ("mit-asis", "the software is provided as is without warranty of any kind .*"),
    ("gpl-named", "(this (work|file|software|program|document|text) is )?(licensed|released) under the( terms of the)? gnu general public "
                  "license( as published by the free software foundation)? version #( only)?"),
    ("gpl-later", "((at your option )?any later version|or at your option any later version)"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                 "public license as published by the free software foundation either version # of the license or at your "
                 "option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty .*"),
    ("lgpl-named", "(this (work|file|software|document|text) is )?(licensed|released) under the gnu lesser general public license version #"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that "
                  "the following conditions are met"),
    ("bsd-source", "(# )?redistributions of source code must retain the above copyright notice .*"),
    ("bsd-binary", "(# )?redistributions in binary form must reproduce the above copyright notice .*"),
    ("bsd-name", "(# )?neither the name of .* may be used to endorse or promote products .*"),
    ("mpl-named", "this source code form is subject to the terms of the mozilla public license v #"),
    ("cc0-named", "(this work is )?(released|dedicated) (under|to) (cc0( #)?|the public domain)"),
    ("cc-by-nc-nd", "(this work is )?licensed under( a)? cc by nc nd #"),
    ("cc-by-nc-sa", "(this work is )?licensed under( a)? cc by nc sa #"),
    ("cc-by-nc", "(this work is )?licensed under( a)? cc by nc #"),
    ("cc-by-nd", "(this work is )?licensed under( a)? cc by nd #"),
    ("cc-by-sa", "(this work is )?licensed under( a)? cc by sa #"),
    ("cc-by", "(this work is )?licensed under( a)? cc by #"),
    ("spdx-other", "spdx license identifier [a-z0-9]+ .*"),
    ("agpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero "
                  "general public license as published by the free software foundation either version # of the license or at "
                  "your option any later version"),
    ("lgpl-free", "this (library|program) is free software you can redistribute it and or modify it under the terms of the gnu "
                  "(lesser|library) general public license as published by the free software foundation either version # of the "
                  "license or at your option any later version"),
    ("gfdl-grant", "permission is granted to copy distribute and or modify this document under the terms of the gnu free "
                   "documentation license version # or any later version published by the free software foundation .*"),
    ("perl-same", "this (program|library|module) is free software you can redistribute it and or modify it under the same terms as "
                  "perl( itself)?"),
    ("isc-grant", "permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby "
                  "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib-asis", "this software is provided as is without any express or implied warranty"),
    ("bsl-named", "(this (work|file|software) is )?(distributed|licensed) under the boost software license version # .*"),
    ("epl-named", "this program and the accompanying materials are made available under the terms of the eclipse public license"
                  "( v| version)? # .*"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("odbl-named", "(this (work|data|database) is )?(made available|licensed) under the open database license .*"),
    ("reserved", "all rights reserved"),
]
#: Full names of the Creative Commons licences.
CREATIVE_COMMONS = {
    "cc-by-nc-nd": "attribution noncommercial noderivatives", "cc-by-nc-sa": "attribution noncommercial sharealike",
    "cc-by-nc": "attribution noncommercial", "cc-by-nd": "attribution noderivatives", "cc-by-sa": "attribution sharealike",
    "cc-by": "attribution",
}
SENTENCES += [(f"{name}-full", "((this (work|document|text|article|page) is )?licensed under( a| the)? )?creative commons "
               f"{words} # (international|unported|generic)( public)?( licen[cs]e)?") for name, words in CREATIVE_COMMONS.items()]

#: Licence rules in the order in which they are tried (identifier sequences).
RULES = [
    ("Apache-2.0-header", ["apache-named", "apache-obey", "apache-copy", "apache-asis"]),
    ("MIT-text", ["mit-grant", "mit-notice", "mit-asis"]),
    ("BSD-3-Clause-text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause-text", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-or-later-header", ["gpl-free", "gpl-hope"]),
    ("GPL-or-later", ["gpl-free"]),
    ("GPL-or-later", ["gpl-named", "gpl-later"]),
    ("GPL", ["gpl-named"]),
    ("GPL", ["spdx-gpl"]),
    ("LGPL", ["lgpl-named"]),
    ("Apache", ["apache-named"]),
    ("Apache-2.0", ["spdx-apache-2.0"]),
    ("MIT", ["mit-named"]),
    ("MIT", ["spdx-mit"]),
    ("BSD-3-Clause", ["spdx-bsd-3"]),
    ("MPL", ["mpl-named"]),
    ("CC0", ["cc0-named"]),
    ("CC-BY-NC-ND", ["cc-by-nc-nd"]),
    ("CC-BY-NC-SA", ["cc-by-nc-sa"]),
    ("CC-BY-NC", ["cc-by-nc"]),
    ("CC-BY-ND", ["cc-by-nd"]),
    ("CC-BY-SA", ["cc-by-sa"]),
    ("CC-BY", ["cc-by"]),
    ("SPDX", ["spdx-other"]),
    ("AGPL-or-later-header", ["agpl-free", "gpl-hope"]),
    ("AGPL-or-later", ["agpl-free"]),
    ("LGPL-or-later", ["lgpl-free"]),
    ("GFDL-or-later", ["gfdl-grant"]),
    ("Perl", ["perl-same"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-asis"]),
    ("BSL", ["bsl-named"]),
    ("EPL", ["epl-named"]),
    ("Unlicense", ["unlicense-free"]),
    ("ODbL", ["odbl-named"]),
    ("All-rights-reserved", ["reserved"]),
]
RULES += [(name.upper(), [f"{name}-full"]) for name in CREATIVE_COMMONS]

#: A text can only have known sentences if it holds one of these words.
_HINT = "licen|spdx|creative|permission|copyright|software|redistribution|version|reserved|domain|cc0|program"
_VERSION = "[0-9](?:[0-9 ]*[0-9])?"


def marked(text: Column) -> Column:
    """Lower-case words with one character between two: a form feed for an empty line, a line feed for a line end or for white
    space after a full stop, semicolon, colon, exclamation or question mark, else a space.  Comment marks go."""
    out = F.regexp_replace(F.translate(F.lower(text), "\t\f", "  "), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"(?m)^([^a-z0-9\n]{0,20})(?:dnl|rem)(?= )", "$1")
    out = F.regexp_replace(out, r"(?<=[.;:!?])(?=\s)", "\t")
    out = F.regexp_replace(out, r"[^a-z0-9\t\n]+", " ")
    out = F.regexp_replace(out, " ?\t[ \t]*", "\t")
    out = F.regexp_replace(out, "[ \t]?\n(?:[ \t]?\n)++[ \t]?", "\f")
    out = F.regexp_replace(out, "[ \t]?\n[ \t]?|\t", "\n")
    return F.regexp_replace(out, "^[ \n\f]+|[ \n\f]+$", "")


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _pattern(sentence: str) -> str:
    """Pattern of a normalised sentence; what follows its last known word is optional."""
    if sentence.endswith(" .*"):
        sentence = sentence[:-3] + "( .*)?"
    return "^" + sentence.replace("#", _VERSION) + "$"


def _spanning(sentence: str) -> str:
    """Pattern of a sentence in a marked text: any mark may stand between its words, words of its own end with its line, words
    within it stay in their paragraph."""
    tail = sentence.endswith(" .*")
    words = sentence[:-3] if tail else sentence
    return words.replace(" ", r"[ \n\f]").replace(".*", r"[^\f]*?").replace("#", _VERSION) + (r"(?: [^\n\f]*)?" if tail else "")


#: Any known sentence, from mark to mark.
_KNOWN = r"(?:^|(?<=[\n\f]))(?:" + "|".join(f"(?:{_spanning(p)})" for _, p in SENTENCES) + r")(?=[\n\f]|$)"


def known_sentences(text: Column) -> Column:
    """Known sentences of a text in order, normalised."""
    return F.transform(F.regexp_extract_all(marked(text), F.lit(_KNOWN), F.lit(0)), normal)


def identify(sentence: Column) -> Column:
    """``identifier@version`` of a normalised sentence (version empty if it has none), null if it is not known."""
    version = F.regexp_extract(sentence, f"(?:version|v|by|nc|nd|sa|gpl|cc0|eclipse public license|attribution|commercial|derivatives|alike) "
                                         f"({_VERSION})", 1)
    # the parameter of an SPDX line without a sentence of its own is its whole expression
    expression = F.regexp_extract(sentence, "^spdx license identifier (.*)$", 1)
    own = "|".join(p[len("spdx license identifier "):] for n, p in SENTENCES if n.startswith("spdx-") and n != "spdx-other")
    version = F.when((expression != "") & ~expression.rlike(f"^(?:{own.replace('#', _VERSION)})$"), expression).otherwise(version)
    version = F.replace(version, F.lit(" "), F.lit("."))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        out = F.when(sentence.rlike(_pattern(pattern)), F.lit(name)).otherwise(out)
    return F.concat(out, F.lit("@"), version)


def scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, sentence_ids`` (known sentences in order), ``licenses`` (as ``name@version``, in order
    of the rules, distinct), ``n_licenses``.

    A rule's sentences must follow each other among the known sentences; unknown sentences between them are passed over.
    Null and empty texts have none.  Repeated rows are answered each; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    known = F.filter(F.transform(known_sentences(text), identify), lambda i: i.isNotNull())
    out = docs.select("doc_id", F.when(F.lower(text).rlike(_HINT), known).otherwise(
        F.array().cast("array<string>")).alias("sentence_ids"))
    # identifiers as one string, ";a@1;b@;": a rule is a pattern on it, and what a rule used becomes "!"
    # the work column is rewritten rule by rule; the found licences are collected beside it
    out = out.withColumn("_l_work", F.when(F.size("sentence_ids") > 0, F.concat(
        F.lit(";"), F.array_join("sentence_ids", ";;"), F.lit(";"))).otherwise(""))
    state = F.struct(F.col("_l_work").alias("work"), F.array().cast("array<string>").alias("found"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_rule(ids)).alias("pattern")) for name, ids in RULES])

    def apply(s, r):
        versions = F.regexp_extract_all(s["work"], r["pattern"], F.lit(1))
        hits = F.transform(versions, lambda v: F.concat(r["name"], F.lit("@"), v))
        return F.struct(F.regexp_replace(s["work"], r["pattern"], F.lit("!")).alias("work"),
                        F.concat(s["found"], hits).alias("found"))

    done = F.aggregate(rules, state, apply)
    left = F.transform(F.regexp_extract_all("_l_left", F.lit(";([^;@]+)@([^;]*);"), F.lit(1)),
                       lambda i: F.concat(F.lit("Unmatched:"), i))
    out = (out.withColumn("_l_done", F.when(F.size("sentence_ids") > 0, done).otherwise(state))
           .withColumn("_l_left", F.col("_l_done.work")))
    found = F.transform(F.array_distinct(F.concat(F.col("_l_done.found"), left)), lambda x: F.regexp_replace(x, "@$", ""))
    return out.select("doc_id", "sentence_ids", found.alias("licenses"), F.size(found).cast("long").alias("n_licenses"))


def _rule(ids: list[str]) -> str:
    """Pattern of a rule on the identifier string; its first group is the version of the first sentence."""
    first, *rest = [i.replace(".", r"\.") for i in ids]
    return f";{first}@([^;]*);" + "".join(f";{i}@[^;]*;" for i in rest)
