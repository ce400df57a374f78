import re

from conftest import SMALL
from corpus import empty, hard, table

from dealgrove.llm import licenses

TEXTS = [
    "Released under the MIT License. Copyright (c) 2020", "MIT license mit-license MIT  LICENSE", "mit licenses", "Apache License, Version 2.0",
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "SPDX-License-Identifier: BSD-3-Clause or SPDX-License-Identifier: GPL-2.0 or later", "Lesser General Public License lesser general public license",
    "Licensed under the terms of the Mozilla Public License", "see the LICENSE file for details; all rights reserved", "permit license", "mıt license é MIT license",
    "you may not use this file except in compliance with the License http://www.apache.org/licenses/LICENSE-2.0", "CC BY-SA 4.0 license, Creative Commons Attribution 4.0 licence",
]
ORDER = ("start", "end", "rule", "priority", "base")


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    spaced = f" {' '.join(words)} "
    found = []
    for k, (_, priority, _, _, pattern, base) in enumerate(licenses.rules()):
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", spaced):
            start = spaced.count(" ", 0, m.start()) - 1
            found.append((start, start + m.group().count(" ") + 1, k, priority, base))
    inner = lambda d, e: e is not d and e[0] <= d[0] and e[1] >= d[1]
    wins = lambda e, d: e[3] > d[3] or (e[3] == d[3] and ((e[0], e[1]) != (d[0], d[1]) or e[2] < d[2]))
    first = [d for d in found if not any(inner(d, e) and wins(e, d) for e in found)]
    kept = [d for d in first if not any(inner(e, d) and e[3] > d[3] for e in first)]
    return len(words), sorted(found), sorted(kept)


def told(rows):
    return sorted(repr((r["doc_id"], r["n_words"], *[sorted(tuple(d[k] for k in ORDER) for d in r[c]) for c in ("found", "kept")])) for r in rows)


def test_matches_and_suppression(spark):
    pairs = [*enumerate(TEXTS), (99, " ".join(TEXTS * 3))]
    assert told(licenses.scan(table(spark, *pairs)).collect()) == sorted(repr((i, *brute(t))) for i, t in pairs)


def test_edges(spark):
    docs, pairs = hard(spark)
    assert told(licenses.scan(docs).collect()) == sorted(repr((i, *brute(t))) for i, t in pairs)
    assert licenses.scan(empty(spark)).count() == 0


def test_sample(spark):
    rows = {r.doc_id: r for r in licenses.query(spark, SMALL).collect()}
    for doc, text in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        n, found, _ = brute(text)
        base = [d for d in found if d[4]]
        starts = [d[0] for d in base]
        labels = ",".join(sorted({licenses.rules()[d[2]][0] for d in base}))
        row = rows[doc]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (n, len(base), min(starts, default=None), max(starts, default=None))
        assert row.base_labels == labels and set(filter(None, labels.split(","))) <= set(row.labels.split(",")) and 0 <= row.score <= 1


def test_there_are_hundreds_of_rules_and_all_compile():
    rules = licenses.rules()
    assert len(rules) > 200 and all(re.compile(r[4]) for r in rules)


def test_ruby_is_found_with_and_without_a_possessive():
    for words in ("ruby license", "licensed under ruby", "spdx license identifier ruby", "ruby s license"):
        assert any(label == "ruby" and re.search(f"(?<= )(?:{pattern})(?= )", f" {words} ") for label, *_, pattern, _ in licenses.rules())
