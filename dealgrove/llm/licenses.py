"""License scans: ordered signature rules behind a keyword gate, with containment suppression.

A text becomes its lower-case words joined by single blanks; every signature is a regular
expression over whole words. A cheap search for the rules' keywords in the raw text leaves
most documents out; in the others a rule runs only if its own keyword occurs. Each match is an
interval of words with the priority of its rule. Of two intervals of which one contains the
other, the one with the lower priority goes; at equal priority the inner one goes, and of equal
intervals the later rule. Everything is a projection of one row: nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrove.llm.base import table

#: Phrases whose places are counted whatever else matches, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label: names as they stand in prose, in words; ``#`` is an optional version and its pattern.
NAMES = r"""
mit: mit | x11 | expat
apache-1.0: apache( software)? #1 0
apache-1.1: apache( software)? #1 1
apache-2.0: apache( software)? #2( 0)? | asl 2( 0)?
gpl-1.0: gnu (general public|gpl) #1( 0)? | gpl ?v?1( 0)?
gpl-2.0: gnu (general public|gpl) #2( 0)? | gpl ?v?2( 0)?
gpl-3.0: gnu (general public|gpl) #3( 0)? | gpl ?v?3( 0)?
lgpl-2.0: (gnu )?(library|lesser) general public #2( 0)? | lgpl ?v?2( 0)?
lgpl-2.1: (gnu )?(library|lesser) general public #2 1 | lgpl ?v?2 1
lgpl-3.0: (gnu )?(library|lesser) general public #3( 0)? | lgpl ?v?3( 0)?
agpl-3.0: (gnu )?affero general public( #3( 0)?)? | agpl ?v?3?( 0)?
gfdl: gnu free documentation | gfdl
bsd-2-clause: (bsd 2 clause|2 clause bsd|simplified bsd|freebsd) | two clause bsd
bsd-3-clause: (bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) | three clause bsd
bsd-4-clause: (bsd 4 clause|4 clause bsd|original bsd|old bsd) | four clause bsd
0bsd: (zero clause bsd|bsd zero clause|0bsd)
isc: isc | internet systems consortium
zlib: zlib | zlib libpng
mpl-1.0: mozilla public #1 0 | mpl ?v?1 0
mpl-1.1: mozilla public #1 1 | mpl ?v?1 1
mpl-2.0: mozilla public #2( 0)? | mpl ?v?2( 0)?
epl-1.0: eclipse public #1( 0)? | epl ?v?1( 0)?
epl-2.0: eclipse public #2( 0)? | epl ?v?2( 0)?
cddl-1.0: common development and distribution( #1( 0)?)? | cddl( #1 0)?
cpl-1.0: common public( #1( 0)?)?
eupl-1.1: european union public #1 1 | eupl ?v?1 1
eupl-1.2: european union public #1 2 | eupl ?v?1 2
artistic-1.0: artistic #1( 0)?
artistic-2.0: artistic #2( 0)?
bsl-1.0: boost software( #1( 0)?)?
unlicense: unlicense
wtfpl: do what the fuck you want to public | wtfpl
cc0-1.0: (creative commons zero|cc0)( #1( 0)?)? | cc0 1 0 universal
cc-by: creative commons attribution( #[1-4]( [05])?)? | cc by( [1-4] [05])?
cc-by-sa: creative commons attribution share ?alike( #[1-4]( [05])?)? | cc by sa( [1-4] [05])?
cc-by-nc: creative commons attribution non ?commercial( #[1-4]( [05])?)? | cc by nc( [1-4] [05])?
cc-by-nd: creative commons attribution no ?deriv(atives|s)?( #[1-4]( [05])?)? | cc by nd( [1-4] [05])?
cc-by-nc-sa: creative commons attribution non ?commercial share ?alike( #[1-4]( [05])?)? | cc by nc sa( [1-4] [05])?
cc-by-nc-nd: creative commons attribution non ?commercial no ?deriv(atives|s)?( #[1-4]( [05])?)? | cc by nc nd( [1-4] [05])?
odbl-1.0: open (data commons open )?database( #1( 0)?)? | odbl( #1 0)?
ofl-1.1: (sil )?open font( #1 1)?
openssl: openssl | ssleay
php-3.01: php #3 0?1
psf-2.0: python software foundation( #2( 0)?)? | psf( #2( 0)?)?
ruby: ruby( s)?
vim: vim
zpl-2.1: zope public #2 1 | zpl 2 1
ms-pl: microsoft public | ms pl
ms-rl: microsoft reciprocal | ms rl
ncsa: (university of illinois|uiuc|ncsa)( ncsa)? open source
postgresql: postgresql
upl-1.0: universal permissive( #1( 0)?)?
afl-3.0: academic free( #3( 0)?)?
osl-3.0: open software( #3( 0)?)?
apsl-2.0: apple public source( #2( 0)?)?
ecl-2.0: educational community( #2( 0)?)?
sspl-1.0: server side public( #1( 0)?)? | sspl( v?1)?
busl-1.1: business source( #1 1)? | busl( 1 1)?
elastic-2.0: elastic #2( 0)?
openrail: (open ?rail|responsible ai)( m| d)?
llama: llama [23]( [0-9])? community
beerware: beer ?ware
json: json
unicode: unicode( #?3( 0)?)?
w3c: w3c( software)?( notice and)?
xfree86: xfree86( #1 1)?
"""

#: Frames that the names stand in: priority, weight, pattern with ``{}`` for the name. All of
#: them hold a word with ``licen``, which gates them; the name's own keyword does so again.
FRAMES = (
    (4, 1.0, r"spdx licen[sc]e identifier {}( only| or later)?"),
    (3, 0.95, r"(distributed|licen[sc]ed|released|available|published|used|covered)( only)? (under|by|with|subject to)( the)?( terms( and conditions)? of)?( the)? {}( public)? licen[sc]e"),
    (2, 0.9, r"{} licen[sc]e(s|d)?( agreement| text| terms)?( v(ersion)? ?[0-9]( [0-9])?)?"),
    (2, 0.8, r"licen[sc]e (is |as |type |name )?(the )?{}"),
    (2, 0.8, r"licen[sc]ed under( the)? {}( or later| or any later version)?"),
)

#: label, priority, weight, keyword and pattern of signatures that are no name.
PHRASES = r"""
mit | 3 | 0.95 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 2 | 0.8 | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | 3 | 0.95 | hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd-2-clause | 2 | 0.7 | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause | 3 | 0.9 | endorse | neither the name of( the)?( [^ ]+){1,8} nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | 3 | 0.9 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
zlib | 3 | 0.9 | misrepresented | the origin of this software must not be misrepresented
apache-2.0 | 3 | 0.95 | compliance | you may not use this file except in compliance with the license
apache-2.0 | 3 | 0.95 | apache | (http |https )?www apache org licenses license 2 0( txt| html)?
apache-1.1 | 3 | 0.9 | apache | this product includes software developed by the apache software foundation
gpl | 2 | 0.85 | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | 3 | 0.9 | gnu | (http |https )?www gnu org licenses( gpl( 3 0| 2 0)?( html| txt)?)?
gpl-2.0-or-later | 3 | 0.95 | version | gnu general public license as published by the free software foundation either version 2 of the license or( at your option)? any later version
gpl-3.0-or-later | 3 | 0.95 | version | gnu general public license as published by the free software foundation either version 3 of the license or( at your option)? any later version
lgpl | 2 | 0.85 | lesser | (library|lesser) general public license
agpl | 2 | 0.85 | affero | affero general public license
mpl-2.0 | 3 | 0.95 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
unlicense | 3 | 0.95 | unencumbered | this is free and unencumbered software released into the public domain
cc0-1.0 | 3 | 0.95 | creativecommons | (http |https )?creativecommons org publicdomain zero 1 0
cc-by | 3 | 0.95 | creativecommons | (http |https )?creativecommons org licenses by [1-4] [05]
cc-by-sa | 3 | 0.95 | creativecommons | (http |https )?creativecommons org licenses by sa [1-4] [05]
cc-by-nc | 3 | 0.95 | creativecommons | (http |https )?creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa | 3 | 0.95 | creativecommons | (http |https )?creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | 3 | 0.95 | creativecommons | (http |https )?creativecommons org licenses by nc nd [1-4] [05]
mit | 3 | 0.9 | opensource | (http |https )?opensource org licenses mit
bsd-3-clause | 3 | 0.9 | opensource | (http |https )?opensource org licenses bsd 3 clause
bsl-1.0 | 3 | 0.9 | boost | (http |https )?www boost org license 1 0 txt
public-domain | 1 | 0.6 | domain | (placed in|released (in)?to|dedicated to|in) the public domain
proprietary | 2 | 0.7 | proprietary | (confidential and proprietary|proprietary and confidential)
proprietary | 2 | 0.7 | unauthorized | unauthorized (copying|use|reproduction)( or distribution)? of this (file|software|document)( via any medium)? is strictly prohibited
proprietary | 1 | 0.5 | reserved | all rights reserved
copyright | 1 | 0.3 | copyright | copyright( c| ©)? (19|20)[0-9][0-9]( (19|20)[0-9][0-9])?
warranty-disclaimer | 1 | 0.4 | warranty | (provided )?as is without warranty of any kind( express or implied)?
any | 0 | 0.2 | license | (see|under) the( terms of the)? license( file)?( for( more)? details| for the specific language governing permissions)?
"""
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEVELS = 5


def keyword(name: str) -> str:
    """The longest word that every form of a name holds, else what its frame holds."""
    fixed = re.sub(r"[a-z0-9]\?|#", "", re.sub(r"\([^()]*\)\??", " ", re.sub(r"\([^()]*\)\?", " ", name)))
    words = [w for w in re.findall(r"[a-z0-9]+", re.sub(r"\[[^]]*\]\??", " ", fixed)) if len(w) > 1]
    return max(words, key=len, default="licen")


def rules() -> list[tuple[str, int, float, str, str, bool]]:
    """(label, priority, weight, keyword, pattern, base) of every signature, in order."""
    found = [(label, 1, 0.8, "license", phrase, True) for phrase, label in BASE.items()]
    for line in PHRASES.strip().splitlines():
        label, priority, weight, word, pattern = (x.strip() for x in line.split(" | ", 4))
        found.append((label, int(priority), float(weight), word, pattern, False))
    for line in NAMES.strip().splitlines():
        label, _, names = line.partition(": ")
        for name in re.split(r" \| ", names):
            full = name.strip().replace("#", "(v|version )?")
            for priority, weight, frame in FRAMES:
                found.append((label, priority, weight, keyword(name), frame.replace("{}", f"({full})"), False))
    return found


def gate() -> str:
    """A pattern for the raw text: a document without a match cannot hold any signature."""
    words = {word for *_, word, _, base in rules()[len(BASE) :][: len(PHRASES.strip().splitlines())]}
    return "(?i)" + "|".join(sorted(words | {"licen"}))


def _signatures() -> Column:
    names = ("label", "priority", "weight", "keyword", "pattern", "base")
    made = []
    for i, (label, priority, weight, word, pattern, base) in enumerate(rules()):
        values = (label, priority, weight, word, f"(?<= )(?:{pattern})(?= )", base)
        made.append(F.struct(F.lit(i).alias("rule"), *[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)]))
    return F.array(*made)


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(words: Column, rule: Column) -> Column:
    """Word intervals of one rule's matches: what stands between them, and they, are counted up."""
    between = F.split(words, rule["pattern"], -1)
    matches = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    start = F.struct(F.lit(0).alias("blanks"), F.array().cast("array<struct<start:int,end:int>>").alias("places"))

    def step(acc: Column, pair: Column) -> Column:
        first = acc["blanks"] + _blanks(pair["a"])
        end = first + _blanks(pair["b"])
        place = F.struct((first - 1).alias("start"), end.alias("end"))
        return F.struct(end.alias("blanks"), F.concat(acc["places"], F.array(place)).alias("places"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    places = F.aggregate(pairs, start, step)["places"]
    kept = ("rule", "label", "priority", "weight", "base")
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), *[rule[k].alias(k) for k in kept]))


def _suppressed(found: Column, inner: bool) -> Column:
    """Drops inner matches of no higher priority than an outer one; else outer ones of a lower one.

    One pass in the order of the intervals (backwards for the outer ones) with the farthest
    (nearest) end so far for each priority.
    """
    kind = "array<struct<start:int,end:int,rule:int,label:string,priority:int,weight:double,base:boolean>>"
    never = -1 if inner else 2**31 - 1
    zero = F.struct(F.array(*[F.lit(never)] * (LEVELS + 1)).alias("ends"), F.array().cast(kind).alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        if inner:
            stays = F.element_at(acc["ends"], d["priority"] + 1) < d["end"]
            ends = F.transform(acc["ends"], lambda e, i: F.when(i <= d["priority"], F.greatest(e, d["end"])).otherwise(e))
        else:
            stays = F.element_at(acc["ends"], d["priority"] + 2) > d["end"]
            ends = F.transform(acc["ends"], lambda e, i: F.when(i <= d["priority"], F.least(e, d["end"])).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(stays, F.concat(acc["kept"], F.array(d))).otherwise(acc["kept"]).alias("kept"))

    keys = F.array_sort(F.transform(found, lambda d: F.struct(d["start"], -d["end"], -d["priority"], d["rule"], d.alias("d"))))
    ordered = F.transform(keys, lambda k: k["d"])
    return F.aggregate(ordered if inner else F.reverse(ordered), zero, step)["kept"]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, ``found`` (all matches) and ``kept`` (those that no other suppresses).

    A match has start and end (words from 0, the end excluded), rule, label, priority, weight
    and base. One row per input row; a null or empty text has no words and no matches.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    counted = docs.select(
        F.col("doc_id").cast("long"),
        F.regexp_count(text, F.lit(RAW_WORD)).cast("long").alias("n_words"),
        F.when(text.rlike(gate()), text).alias("text"),
    )
    words = F.array_join(F.regexp_extract_all(F.translate("text", upper, lower), F.lit(WORD), F.lit(0)), " ")
    spaced = counted.select("doc_id", "n_words", F.concat(F.lit(" "), words, F.lit(" ")).alias("words"))
    active = F.filter(_signatures(), lambda r: F.contains(F.col("words"), r["keyword"]))
    found = F.flatten(F.transform(active, lambda r: _places(F.col("words"), r)))
    none = F.array().cast("array<struct<start:int,end:int,rule:int,label:string,priority:int,weight:double,base:boolean>>")
    matched = spaced.select("doc_id", "n_words", F.coalesce(found, none).alias("found"))
    return matched.withColumn("kept", _suppressed(_suppressed(F.col("found"), True), False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda d: d["base"])
    told = F.concat(base, F.col("kept"))
    names = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")
    starts = F.transform(base, lambda d: d["start"].cast("long"))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(told).alias("labels"),
        F.coalesce(F.array_max(F.transform(told, lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )
