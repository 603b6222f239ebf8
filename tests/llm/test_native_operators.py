"""Sharding, quality rules, licence rules and chat formatting against plain Python."""

import collections
import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringwise.llm import chat, licenses, quality, sharding
from ringwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# --- op4 -----------------------------------------------------------------------------------------------------------

def check_shards(rows, docs, shards):
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in docs)
    size = {i: len((t or "").encode()) + 8 for i, t in docs}
    crc = {i: zlib.crc32((t or "").encode()) for i, t in docs}
    by = collections.defaultdict(list)
    for r in rows:
        assert (r["size"], r.text_crc32) == (size[r.doc_id], crc[r.doc_id]) and 0 <= r.shard < shards
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r["size"] for r in by[s]) for s in range(shards)]


def test_sharding_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(SF + "/documents.parquet").collect()]
    rows = QUERIES["op4_virtual_slot_sharding"](spark, SF).collect()
    sums = check_shards(rows, docs, 24)
    assert max(sums) - min(sums) <= max(len(t.encode()) + 8 for _, t in docs)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


@pytest.mark.parametrize("block", [sharding.BLOCK, 7])
def test_null_and_repeated_ids_spread(spark, tmp_path, monkeypatch, block):
    """A third null ids, a third one id with one text, the rest distinct: shards stay near equal, nothing is lost."""
    monkeypatch.setattr(sharding, "BLOCK", block)
    docs = [(None, f"text {i} of nobody") for i in range(3000)] + [(7, "the same text again")] * 3000
    docs += [(100 + i, f"text {i} of one") for i in range(3000)] + [(None, None)] * 50
    df = spark.createDataFrame([(i, t, 5, 5) for i, t in docs], "doc_id long, text string, size int, copy int").repartition(6)
    rows = sharding.shard(df, 8, str(tmp_path / "maps")).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    sums = [sum(x["size"] for x in by[s]) for s in range(8)]
    assert max(sums) < 1.02 * min(sums)


def test_rebalance_equals_a_plain_greedy(spark):
    """The map's edit against the same rule in plain Python."""
    r = random.Random(8)
    sizes = {v: r.choice([0, 0, 5, 5, 40, 900]) * r.randrange(1, 50) for v in range(120)}
    shard_of = {v: r.randrange(5) for v in range(120)}
    shards = 4
    mean = sum(sizes.values()) / shards
    new, load, moved = {}, [0] * shards, []
    for s in range(5):
        held = 0
        for v in sorted((v for v in shard_of if shard_of[v] == s), key=lambda v: (-sizes[v], v)):
            held += sizes[v]
            if s < shards and (held <= mean or sizes[v] == 0):
                new[v], load[s] = s, load[s] + sizes[v]
            else:
                moved.append(v)
    for v in sorted(moved, key=lambda v: (-sizes[v], v)):
        to = load.index(min(load))
        new[v], load[to] = to, load[to] + sizes[v]
    got = sharding.rebalance(
        spark.createDataFrame([(0, v, s) for v, s in shard_of.items()], "version int, vslot int, shard int"),
        spark.createDataFrame([(v, b, 1) for v, b in sizes.items()], "vslot int, bytes long, rows long"), shards).collect()
    assert {x.vslot: x.shard for x in got} == new and {x.version for x in got} == {1}


def test_sharding_grows_by_editing_the_map(spark, tmp_path):
    r = random.Random(1)
    docs = [(i, "x" * r.choice((0, 5, 50, 400))) for i in range(800)] + [(900, None), (None, "null id"), (901, "y" * 3000)]
    df = spark.createDataFrame([(i, t, 1, "a") for i, t in docs], "doc_id long, text string, slot int, shard string")
    path = str(tmp_path / "maps")
    first = sharding.shard(df, 4, path, slots=256).collect()
    sums = check_shards(first, docs, 4)
    assert max(sums) - min(sums) <= 4000
    again = sharding.shard(df, 5, path, slots=256).collect()
    check_shards(again, docs, 5)
    was = {x.doc_id: x.shard for x in first}
    assert sum(was[x.doc_id] != x.shard for x in again) < 0.45 * len(docs)  # most records stay where they were
    assert sorted({x.version for x in spark.read.parquet(path).collect()}) == [0, 1, 2]
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 3, str(tmp_path / "none")).count() == 0


# --- op5 -----------------------------------------------------------------------------------------------------------

def base(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    windows = collections.defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i:i + 3])].append(i)
    covered = {j for v in windows.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def odd_texts():
    r = random.Random(3)
    out = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x " * 300, "é\x0bü\x1cz #*$%&|<>", "l\nl\nl\n\n m\nm ",
           "    \x85", "a b c d " * 40 + " ".join(f"u{i}" for i in range(400))]
    return out + [" ".join(r.choice("abcdefg") for _ in range(r.choice((5, 60, 200)))) for _ in range(20)]


def test_base_counts(spark):
    docs = list(enumerate(odd_texts()))
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, llr string, kept int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    for i, t in docs:
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), (i, t)
        assert r.kept == (not r.base_failed)
    assert quality.judge(df.where("false"), labels).count() == 0


def test_quality_query(spark):
    sf = "/root/testdata/sf0.01"  # sf0.001 has some 70 trusted documents, too few for two multinomials
    docs = {r.doc_id: r.text for r in spark.read.parquet(sf + "/documents.parquet").collect()}
    good = {r.doc_id: r.quality for r in spark.read.parquet(sf + "/labels.parquet").collect()}
    rows = QUERIES["op5_quality_rules"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(docs)
    right = []
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(docs[r.doc_id])
        if r.doc_id in good and not r.base_failed:
            right.append(r.kept == bool(good[r.doc_id]))
    assert sum(right) >= 0.97 * len(right)


def test_filter_keeps_columns_and_rejects_all_columns_clashes(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(60)), "q", 1.5), (2, "short", "r", 2.5), (None, " ".join(f"w{i}" for i in range(70)), "s", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, llr double")
    labels = spark.createDataFrame([(1, 1, 0), (9, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.keep_good(df, labels)
    assert out.columns == df.columns and sorted((tuple(r) for r in out.collect()), key=str) == sorted((rows[0], rows[2]), key=str)


# --- op8 -----------------------------------------------------------------------------------------------------------

CASES = [
    (None, []), ("", []), ("nothing here.", []),
    ("Licensed under the Apache License, Version 2.0.", ["Apache@2.0"]),
    ("Word. Released under the MIT License. More words.", ["MIT"]),
    ("a\nThis work is licensed under the GNU General Public License, version 3.\nb", ["GPL@3"]),
    ("GNU. Licensed under the GNU General Public License, version 2; or (at your option) any later version.", ["GPL-or-later@2"]),
    ("Licensed under CC BY-NC 4.0. Licensed under CC BY 3.0.", ["CC-BY-NC@4.0", "CC-BY@3.0"]),
    ("LICENSED UNDER  THE APACHE LICENSE, version 2.0\nReleased under the MIT license.", ["Apache@2.0", "MIT"]),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the "
     "License.\nYou may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable "
     "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied.", ["Apache-2.0-header@2.0"]),
    ("You may not use this file except in compliance with the License.", ["Unmatched:apache-obey"]),
    ("The licence of the sea is wide.", []),
]


def test_licence_rules(spark):
    df = spark.createDataFrame([(i, t, ["q"], 1) for i, (t, _) in enumerate(CASES)],
                               "doc_id long, text string, licenses array<string>, sentence_ids int")
    got = {r.doc_id: (r.licenses, r.n_licenses) for r in licenses.scan(df).collect()}
    assert got == {i: (want, len(want)) for i, (_, want) in enumerate(CASES)}
    assert licenses.scan(df.where("false")).count() == 0


def test_licence_query_finds_the_documents_lines(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: set(r.licenses) for r in QUERIES["op8_license_sentence_rules"](spark, "/root/testdata/sf0.01").collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC@4.0", "Licensed under the Apache License, Version 2.0.": "Apache@2.0",
             "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL@3"}
    assert set(got) == set(docs)
    for i, text in docs.items():
        assert {v for k, v in lines.items() if k in text} <= got[i]


WORDINGS = {
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0", "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-gpl@2.0": "SPDX-License-Identifier: GPL-2.0-or-later", "spdx-bsd-3": "SPDX-License-Identifier: BSD-3-Clause",
    "apache-named@2.0": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-obey": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0",
    "apache-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an '
                   '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-named": "This software is released under the terms of the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
                 'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
                 'modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the '
                 'Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
                  "Software.",
    "mit-asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
                'WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "gpl-named@2": "This program is licensed under the terms of the GNU General Public License as published by the Free Software Foundation, "
                   "version 2 only.",
    "gpl-later": "or (at your option) any later version.",
    "gpl-free@2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                  "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-free@3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                  "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
                "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-named@2.1": "This file is licensed under the GNU Lesser General Public License, version 2.1.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                 "conditions are met:",
    "bsd-source": "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
                  "disclaimer.",
    "bsd-binary": "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                  "disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "3. Neither the name of Foo, Inc. nor the names of its contributors may be used to endorse or promote products derived from "
                "this software without specific prior written permission.",
    "mpl-named@2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc0-named": "This work is dedicated to the public domain.",
    "spdx-other@isc": "SPDX-License-Identifier: ISC",
    "agpl-free@3": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General "
                   "Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) "
                   "any later version.",
    "lgpl-free@2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                     "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
                     "option) any later version.",
    "gfdl-grant@1.3": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
                      "Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no "
                      "Invariant Sections.",
    "perl-same@": "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself.",
    "isc-grant@": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                  "provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib-asis@": "This software is provided 'as-is', without any express or implied warranty.",
    "bsl-named@1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file)",
    "epl-named@2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
                     "which is available at their site",
    "unlicense-free@": "This is free and unencumbered software released into the public domain.",
    "odbl-named@": "This database is made available under the Open Database License",
    "cc-by-full@4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-full@3.0": "Creative Commons Attribution-ShareAlike 3.0 Unported License",
    "cc-by-nd-full@4.0": "Creative Commons Attribution-NoDerivatives 4.0 International",
    "cc-by-nc-full@2.5": "Licensed under the Creative Commons Attribution-NonCommercial 2.5 Generic Licence",
    "cc-by-nc-sa-full@4.0": "Creative Commons Attribution NonCommercial ShareAlike 4.0 International Public License",
    "cc-by-nc-nd-full@4.0": "Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License",
    "cc-by-nc-nd@4.0": "This work is licensed under a CC BY-NC-ND 4.0.", "cc-by-nc-sa@4.0": "This work is licensed under a CC BY-NC-SA 4.0.",
    "cc-by-nc@4.0": "This work is licensed under a CC BY-NC 4.0.", "cc-by-nd@4.0": "This work is licensed under a CC BY-ND 4.0.",
    "cc-by-sa@4.0": "This work is licensed under a CC BY-SA 4.0.", "cc-by@4.0": "This work is licensed under a CC BY 4.0.",
    "reserved": "All rights reserved.",
}


def test_every_known_sentence_in_its_canonical_wording(spark):
    assert {k.split("@")[0] for k in WORDINGS} == {name for name, _ in licenses.SENTENCES}
    docs, want = [], []
    for key, text in WORDINGS.items():
        lines = [y for x in text.split("\n") for y in textwrap.wrap(x, 30, break_on_hyphens=False) or [""]]
        for form in (text, "Some words. " + text + (" " if text[-1] in ".;:" else "\n") + "More words follow.", "\n".join(lines), "\r\n".join(lines),
                     "/*\n" + "".join(f" * {x}\n" for x in lines) + " */", "".join(f"# {x}\n" for x in lines) + "import os\n",
                     "".join(f"dnl {x}\n" for x in lines), "".join(f"// {x}\n" for x in ["Copyright 2020 Foo", "", *lines, "", "x = 1"])):
            docs.append((len(docs), form))
            want.append([key if "@" in key else key + "@"])
    rows = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r.doc_id: r.sentence_ids for r in rows}
    wrong = [(t, got[i], w) for (i, t), w in zip(docs, want) if got[i] != w]
    assert not wrong, wrong


@pytest.mark.parametrize("line,want", [
    ("ISC", "SPDX@isc"), ("MIT OR Apache-2.0", "SPDX@mit.or.apache.2.0"), ("MPL-2.0", "SPDX@mpl.2.0"), ("AGPL-3.0-only", "SPDX@agpl.3.0.only"), ("BSD-2-Clause", "SPDX@bsd.2.clause"),
    ("LGPL-2.1-or-later", "SPDX@lgpl.2.1.or.later"), ("GPL-2.0-only WITH Classpath-exception-2.0", "SPDX@gpl.2.0.only.with.classpath.exception.2.0"),
    ("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-2.0-only", "GPL@2.0")])
def test_spdx_lines(spark, line, want):
    df = spark.createDataFrame([(1, f"// SPDX-License-Identifier: {line}\nint main;")], "doc_id long, text string")
    assert licenses.scan(df).first().licenses == [want]


def test_hyphenated_creative_commons_name(spark):
    """A name of more than 30 letters without a space, on one line and wrapped after it."""
    line = "This work is licensed under a\n{} Commons Attribution-NonCommercial-ShareAlike 4.0\nInternational License."
    df = spark.createDataFrame([(1, line.format("Creative"))], "doc_id long, text string")
    assert licenses.scan(df).first().licenses == ["CC-BY-NC-SA@4.0"]


def test_rules_equal_a_plain_matcher(spark):
    """Random orders of known sentences among other text; rules applied by lists in plain Python."""
    r = random.Random(21)
    filler = ["The sea was calm that day.", "Version control is of use.", "No permission was asked, and none was given."]
    docs, want = [], []
    for d in range(150):
        ids = [r.choice(list(WORDINGS)) for _ in range(r.randrange(0, 7))]
        if r.random() < 0.5:
            name, seq = r.choice(licenses.RULES)
            at = r.randrange(len(ids) + 1)
            ids[at:at] = [next(k for k in WORDINGS if k.split("@")[0] == s) for s in seq]
        parts = [p for k in ids for p in [WORDINGS[k]] + r.sample(filler, r.randrange(0, 2))]
        docs.append((d, "\n\n".join(parts)))
        found, work = [], list(ids)
        for name, seq in licenses.RULES:
            i = 0
            while i + len(seq) <= len(work):
                if [x and x.split("@")[0] for x in work[i:i + len(seq)]] == seq:
                    found.append((name + "@" + work[i].partition("@")[2]).rstrip("@"))
                    work[i:i + len(seq)] = [None]
                i += 1
        found += ["Unmatched:" + x.split("@")[0] for x in work if x]
        want.append(([k if "@" in k else k + "@" for k in ids], list(dict.fromkeys(found))))
    got = {x.doc_id: (x.sentence_ids, x.licenses) for x in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, w in enumerate(want):
        assert got[d] == w, docs[d][1]


def test_wrapped_licence_texts(spark):
    def block(*keys):
        return "\n *\n".join(textwrap.fill(WORDINGS[k], 72, initial_indent=" * ", subsequent_indent=" * ") for k in keys)

    cases = [(block("mit-grant", "mit-notice", "mit-asis"), ["MIT-text"]), (block("gpl-free@3", "gpl-hope"), ["GPL-or-later-header@3"]),
             (block("gpl-free@2", "gpl-hope"), ["GPL-or-later-header@2"]),
             (block("bsd-grant", "bsd-source", "bsd-binary", "bsd-name"), ["BSD-3-Clause-text"]),
             (block("apache-named@2.0", "apache-obey", "apache-copy", "apache-asis"), ["Apache-2.0-header@2.0"]),
             ("# SPDX-License-Identifier: MIT\nimport os", ["MIT"]), (block("mpl-named@2.0"), ["MPL@2.0"]),
             ("but WITHOUT ANY WARRANTY.\nAll rights reserved.", ["All-rights-reserved"]),
             (WORDINGS["gpl-hope"].split(";")[0] + ".\nAll rights reserved.", ["All-rights-reserved", "Unmatched:gpl-hope"]),
             ("This is not a sentence about the MIT License or all rights reserved by v. 2.0", []),
             ("Licensed under the Apache License, version 2.\n2024 was wet.", ["Apache@2"]), ("! " * 20000 + "software", []),
             ("é" * 20000 + " software\n\n\n", []), ("\n" * 20000 + "MIT License", ["MIT"])]
    rows = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in rows} == {i: w for i, (_, w) in enumerate(cases)}


# --- op9 -----------------------------------------------------------------------------------------------------------

def told(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(SF + "/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    bad = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", bad), (-1, 1, "assistant", bad)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op9_chat_round_trip"](spark, SF).collect()}
    assert got == told(rows)


def test_any_text_survives(spark):
    r = random.Random(8)
    bits = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "<", "|", "\\", ">", "%", "%0A", "é😀", "<\\|", "<\\\\|im_end|>", " ", "$1"]
    rows = []
    for conv in range(120):
        for turn in range(r.randint(1, 5)):
            rows.append((conv, turn, r.choice(["user", "assistant", None, "", "".join(r.choices(bits, k=2))]),
                         r.choice([None, "", "".join(r.choices(bits, k=r.randint(1, 9)))])))
    rows += [(500, None, "user", "a"), (500, None, "user", "a"), (500, 1, "assistant", "b"), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*x, "z") for x in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df)
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat.digest(out).collect()}
    assert got == told(rows)
    shown = {x.conv_id: x for x in out.collect()}
    assert any(x.escaped for x in shown.values()) and not all(x.escaped for x in shown.values())
    for x in shown.values():  # control strings in the output are the template's only
        assert x.formatted.count("<|") == 2 * x.n_source_turns
    assert chat.format_conversations(df.where("false")).count() == 0


@pytest.mark.parametrize("query", ["op4_virtual_slot_sharding", "op5_quality_rules", "op8_license_sentence_rules", "op9_chat_round_trip"])
def test_no_python_in_the_plan(spark, query):
    plan = QUERIES[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_words_split_like_the_contract(spark):
    df = spark.createDataFrame([(t,) for t in odd_texts()], "text string")
    for r in quality.with_words(df).select(F.col("_q_text").alias("t"), F.col("_q_words").alias("w")).collect():
        assert r.w == [x for x in re.split(r"[\x20\x09-\x0D]+", r.t) if x]


def test_all_trusted_documents_count(spark):
    n = 20_500
    labels = spark.range(n).selectExpr("id * 3 as doc_id", "1 as quality", "0 as toxic").union(
        spark.createDataFrame([(1, 0, 0), (4, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    ids = quality.trusted_ids(labels)
    assert ids.count() == n
    docs = spark.range(3 * n + 50).selectExpr("if(id % 1000 = 7, null, id) as doc_id", "cast(id as string) as text")
    docs = docs.unionByName(docs.where("doc_id = 3"))  # a repeated id is trusted both times
    got = [r.doc_id for r in quality.trusted_docs(docs, ids).collect()]
    assert sorted(got) == sorted([3 * i for i in range(n) if 3 * i % 1000 != 7] + [3])
    assert quality.trusted_docs(docs, ids.where("false")).count() == 0


def test_threshold_is_the_quantile_of_all_trusted(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 59), i -> concat('w', (i * (id + 3)) % 97))) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) as quality", "0 as toxic")
    rows = quality.judge(docs, labels).collect()
    want = np.quantile([r.llr for r in rows if r.doc_id % 2 == 0], quality.TAIL) - quality.MARGIN
    assert {round(r.threshold, 12) for r in rows} == {round(float(want), 12)}
