"""License scan by ordered signature rules.

A text is brought to words joined by one space. An Aho-Corasick automaton
looks for the rules' keywords; only the regexes of rules whose keyword occurs
are run. Detections are resolved in order of priority, then length, then
place: one that lies within an accepted interval is dropped.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrays, pieces

#: Phrase -> label; all their places are counted, whatever the rules find.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label | keyword | regex of its name, in words joined by one space | its identifiers, written as words
FAMILIES = """
gpl-1.0|gpl|(?:gnu )?(?:general public licen[cs]e|gpl) (?:version |v ?)?1(?: 0)?|gpl 1 0
gpl-2.0|gpl|(?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?|gpl 2 0
gpl-2.0|general public|(?:gnu )?general public licen[cs]e (?:version |v ?)?2(?: 0)?|gpl 2 0 only
gpl-3.0|gpl|(?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?|gpl 3 0
gpl-3.0|general public|(?:gnu )?general public licen[cs]e (?:version |v ?)?3(?: 0)?|gpl 3 0 only
agpl-3.0|affero|(?:gnu )?affero general public licen[cs]e(?: (?:version |v ?)?3(?: 0)?)?|agpl 3 0
lgpl-2.0|library general|(?:gnu )?library general public licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?|lgpl 2 0
lgpl-2.1|lesser general|(?:gnu )?lesser general public licen[cs]e (?:version |v ?)?2 1|lgpl 2 1
lgpl-3.0|lesser general|(?:gnu )?lesser general public licen[cs]e (?:version |v ?)?3(?: 0)?|lgpl 3 0
gfdl|free documentation|(?:gnu )?free documentation licen[cs]e(?: (?:version |v ?)?1(?: [123])?)?|gfdl 1 3
apache-1.1|apache|apache (?:software )?licen[cs]e (?:version |v ?)?1 1|apache 1 1
apache-2.0|apache|apache (?:software )?licen[cs]e (?:version |v ?)?2(?: 0)?|apache 2 0
mit|mit|(?:the )?mit (?:x11 )?licen[cs]e|mit
x11|x11|x11 licen[cs]e|x11
bsd-2-clause|bsd|(?:simplified |freebsd )?bsd 2 clause(?: licen[cs]e)?|bsd 2 clause
bsd-3-clause|bsd|(?:new |modified |revised )?bsd 3 clause(?: licen[cs]e)?|bsd 3 clause
bsd-4-clause|bsd|(?:original |old )?bsd 4 clause(?: licen[cs]e)?|bsd 4 clause
bsd|bsd|bsd(?: style)? licen[cs]e|bsd
0bsd|bsd|(?:zero clause bsd|0bsd)(?: licen[cs]e)?|0bsd
isc|isc|isc licen[cs]e|isc
mpl-1.1|mozilla|mozilla public licen[cs]e (?:version |v ?)?1 1|mpl 1 1
mpl-2.0|mozilla|mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?|mpl 2 0
epl-1.0|eclipse|eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?|epl 1 0
epl-2.0|eclipse|eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?|epl 2 0
edl-1.0|eclipse|eclipse distribution licen[cs]e|edl 1 0
cddl-1.0|common development|common development and distribution licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?|cddl 1 0
cpl-1.0|common public|common public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?|cpl 1 0
ibmpl-1.0|ibm public|ibm public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?|ipl 1 0
eupl-1.2|european union public|european union public licen[cs]e(?: (?:version |v ?)?1(?: [12])?)?|eupl 1 2
osl-3.0|open software licen|open software licen[cs]e(?: (?:version |v ?)?3(?: 0)?)?|osl 3 0
afl-3.0|academic free|academic free licen[cs]e(?: (?:version |v ?)?3(?: 0)?)?|afl 3 0
artistic-1.0|artistic|artistic licen[cs]e (?:version |v ?)?1(?: 0)?|artistic 1 0
artistic-2.0|artistic|artistic licen[cs]e (?:version |v ?)?2(?: 0)?|artistic 2 0
bsl-1.0|boost|boost software licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?|bsl 1 0
busl-1.1|business source|business source licen[cs]e(?: (?:version |v ?)?1(?: 1)?)?|busl 1 1
elastic-2.0|elastic|elastic licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?|elastic 2 0
sspl-1.0|server side public|server side public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?|sspl 1 0
zlib|zlib|zlib(?: libpng)? licen[cs]e|zlib
libpng|libpng|libpng licen[cs]e|libpng
openssl|openssl|openssl licen[cs]e|openssl
php-3.01|php|php licen[cs]e(?: (?:version |v ?)?3(?: 01)?)?|php 3 01
psf-2.0|python software foundation|python software foundation licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?|psf 2 0
ruby|ruby|ruby licen[cs]e|ruby
postgresql|postgresql|postgresql licen[cs]e|postgresql
unlicense|unlicense|(?:the )?unlicense|unlicense
wtfpl|wtfpl|wtfpl(?: (?:version |v ?)?2)?|wtfpl
cc0-1.0|cc0|cc0(?: 1 0)?(?: universal)?|cc0 1 0
cc0-1.0|public domain dedication|public domain dedication|cc0
cc-by-2.0|cc by|cc by 2 0|cc by 2 0
cc-by-3.0|cc by|cc by 3 0|cc by 3 0
cc-by-4.0|cc by|cc by 4 0|cc by 4 0
cc-by-sa-3.0|cc by sa|cc by sa 3 0|cc by sa 3 0
cc-by-sa-4.0|cc by sa|cc by sa 4 0|cc by sa 4 0
cc-by-nc-4.0|cc by nc|cc by nc 4 0|cc by nc 4 0
cc-by-nc-sa-4.0|cc by nc sa|cc by nc sa 4 0|cc by nc sa 4 0
cc-by-nd-4.0|cc by nd|cc by nd 4 0|cc by nd 4 0
cc-by-nc-nd-4.0|cc by nc nd|cc by nc nd 4 0|cc by nc nd 4 0
cc-by|creative commons|creative commons attribution(?: (?:[234] 0))?(?: (?:international|generic|unported))?(?: licen[cs]e)?|cc by
cc-by-sa|creative commons|creative commons attribution share ?alike(?: (?:[234] 0))?(?: (?:international|generic|unported))?(?: licen[cs]e)?|cc by sa
cc-by-nc|creative commons|creative commons attribution non ?commercial(?: (?:[234] 0))?(?: (?:international|generic|unported))?(?: licen[cs]e)?|cc by nc
cc-by-nd|creative commons|creative commons attribution no ?deriv(?:ative|ative work)?s?(?: (?:[234] 0))?(?: licen[cs]e)?|cc by nd
odbl-1.0|open database|open database licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?|odbl 1 0
odc-by-1.0|open data commons|open data commons attribution licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?|odc by 1 0
pddl-1.0|public domain dedication and|public domain dedication and licen[cs]e|pddl 1 0
ofl-1.1|open font|(?:sil )?open font licen[cs]e(?: (?:version |v ?)?1(?: 1)?)?|ofl 1 1
ms-pl|microsoft public|microsoft public licen[cs]e|ms pl
ms-rl|microsoft reciprocal|microsoft reciprocal licen[cs]e|ms rl
ncsa|ncsa|(?:university of illinois )?ncsa open source licen[cs]e|ncsa
upl-1.0|universal permissive|universal permissive licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?|upl 1 0
vim|vim|vim licen[cs]e|vim
w3c|w3c|w3c software (?:notice and )?licen[cs]e|w3c
mulan-2.0|mulan|mulan p(?:ermissive )?s(?:oftware )?l(?:icen[cs]e)?(?: (?:version |v ?)?2)?|mulanpsl 2 0
llama|llama|llama \\d(?: \\d)? community licen[cs]e|llama
openrail|openrail|(?:bigscience |creativeml )?openrail(?: m)?(?: licen[cs]e)?|openrail m
"""

#: name | priority | weight | pattern round a family's NAME or ID
FORMS = """
identifier|5|1.0|spdx licen[cs]e identifier ID
notice|4|0.95|(?:licen[cs]ed|released|distributed|published|available|provided|redistributed|covered|governed) (?:\\w+ )?(?:under|by|subject to) (?:the )?(?:terms (?:and conditions )?of )?(?:the |a )?NAME
name|3|0.8|NAME
"""

#: label | keyword | priority | weight | regex: texts of licenses and notices that name none
TEXTS = r"""
mit|permission is hereby granted|4|0.95|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit|above copyright notice|4|0.9|the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
mit|provided as is|3|0.8|the software is provided as is without warranty of any kind
mit|authors or copyright|3|0.8|in no event shall the authors or copyright holders be liable for any claim damages or other liability
isc|permission to use copy|4|0.9|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|disclaims all|4|0.85|the software is provided as is and (?:the author|\w+) disclaims all warranties with regard to this software
0bsd|permission to use copy|4|0.85|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
bsd|redistribution and use|4|0.9|redistribution and use in source and binary forms with or without modification are permitted
bsd|redistributions of source|4|0.85|redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer
bsd|redistributions in binary|4|0.85|redistributions in binary form must reproduce the (?:above )?copyright notice this list of conditions and the following disclaimer
bsd-3-clause|endorse or promote|4|0.9|neither the names? of (?:\S+ ){1,15}may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause|advertising materials|4|0.9|all advertising materials mentioning features or use of this software must display the following acknowledg?ement
bsd|this software is provided by|4|0.8|this software is provided by (?:\S+ ){1,6}as is and any express or implied warranties
apache-2.0|may not use this file|4|0.9|you may not use this file except in compliance with the licen[cs]e
apache-2.0|unless required by applicable|4|0.9|unless required by applicable law or agreed to in writing (?:software|licensor) (?:\S+ ){1,10}on an as is basis
apache-2.0|terms and conditions for use|4|0.85|terms and conditions for use reproduction and distribution
apache-2.0|grant of patent|3|0.8|grant of patent licen[cs]e subject to the terms and conditions of this licen[cs]e each contributor hereby grants to you
apache-2.0|contributor license agreement|1|0.4|apache (?:\S+ ){0,3}contributor license agreement
gpl|free software foundation|3|0.8|under the terms of the gnu general public licen[cs]e as published by the free software foundation
gpl-1.0-or-later|any later version|4|0.9|(?:either )?version 1 (?:of the licen[cs]e )?or at your option any later version
gpl-2.0-or-later|any later version|4|0.9|(?:either )?version 2 (?:of the licen[cs]e )?or at your option any later version
gpl-3.0-or-later|any later version|4|0.9|(?:either )?version 3 (?:of the licen[cs]e )?or at your option any later version
lgpl-2.1-or-later|any later version|4|0.9|(?:either )?version 2 1 (?:of the licen[cs]e )?or at your option any later version
gpl-2.0-or-later|gpl|6|0.9|(?:gnu )?gpl ?(?:version |v ?)?2(?: 0)? or (?:any )?later(?: version)?
gpl-3.0-or-later|gpl|6|0.9|(?:gnu )?gpl ?(?:version |v ?)?3(?: 0)? or (?:any )?later(?: version)?
lgpl-2.1-or-later|gpl|6|0.9|(?:gnu )?lgpl ?(?:version |v ?)?2 1 or (?:any )?later(?: version)?
lgpl-3.0-or-later|gpl|6|0.9|(?:gnu )?lgpl ?(?:version |v ?)?3(?: 0)? or (?:any )?later(?: version)?
agpl-3.0-or-later|gpl|6|0.9|(?:gnu )?agpl ?(?:version |v ?)?3(?: 0)? or (?:any )?later(?: version)?
gpl|in the hope that|4|0.8|this program is distributed in the hope that it will be useful but without any warranty
lgpl|in the hope that|4|0.8|this library is distributed in the hope that it will be useful but without any warranty
gpl|you should have received|4|0.8|you should have received a copy of the gnu general public licen[cs]e
lgpl|you should have received|4|0.8|you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e
agpl|you should have received|4|0.8|you should have received a copy of the gnu affero general public licen[cs]e
gpl-2.0|copying distribution and modification|4|0.85|terms and conditions for copying distribution and modification
gpl-3.0|copyleft|4|0.85|the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works
agpl-3.0|copyleft|4|0.85|the gnu affero general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works
agpl-3.0|interacting with it remotely|3|0.8|all users interacting with it remotely through a computer network
gpl|everyone is permitted to copy|3|0.7|everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed
gfdl|permission is granted to copy|4|0.9|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
mpl-1.1|contents of this file|4|0.9|the contents of this file are subject to the mozilla public licen[cs]e version 1 1
mpl-2.0|source code form|4|0.9|this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-2.0|incompatible with secondary|3|0.8|this source code form is incompatible with secondary licen[cs]es as defined by the mozilla public licen[cs]e
epl-2.0|accompanying materials|4|0.9|this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v ?)?2 0
epl-1.0|accompanying materials|4|0.9|this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1 0
cddl-1.0|common development|4|0.9|the contents of this file are subject to the terms of the common development and distribution licen[cs]e
zlib|altered source versions|4|0.9|altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib|express or implied warranty|4|0.85|this software is provided as is without any express or implied warranty in no event will the authors be held liable
bsl-1.0|person or organization obtaining|4|0.9|permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense|free and unencumbered|4|0.9|this is free and unencumbered software released into the public domain
wtfpl|do what the fuck|4|0.9|you just do what the fuck you want to(?: public licen[cs]e)?
wtfpl|do what the fuck|4|0.9|do what the fuck you want to public licen[cs]e
cc0-1.0|affirmer|4|0.9|affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc0-1.0|dedicated the work|4|0.9|has dedicated the work to the public domain by waiving all of his or her rights to the work
cc0-1.0|waived all copyright|4|0.9|waived all copyright and related (?:or|and) neighbou?ring rights
cc-by-4.0|attribution 4 0 international|4|0.9|creative commons attribution 4 0 international (?:public )?licen[cs]e
cc-by-sa-4.0|sharealike 4 0|4|0.9|creative commons attribution sharealike 4 0 international (?:public )?licen[cs]e
cc-by-sa|build upon|3|0.7|if you (?:alter transform or build upon this work|remix transform or build upon the material) you (?:may|must) distribute
cc-by-nc|commercial advantage|3|0.7|primarily intended for or directed toward(?:s)? commercial advantage or (?:private )?monetary compensation
cc|appropriate credit|2|0.5|you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made
cc|to view a copy|2|0.5|to view a copy of this licen[cs]e visit (?:http|https) creativecommons org licen[cs]es(?: \S+){1,3}
ofl-1.1|reserved font name|4|0.9|(?:with|no modified version of the font software may use the) reserved font names?
ofl-1.1|font software|4|0.9|this font software is licen[cs]ed under the sil open font licen[cs]e
artistic-2.0|given free software package|3|0.8|this licen[cs]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed
psf-2.0|python software foundation|4|0.9|this licen[cs]e agreement is between the python software foundation psf and the individual or organization
openssl|openssl|4|0.9|this product includes software developed by the openssl project for use in the openssl toolkit
ncsa|with the software without restriction|4|0.85|to deal with the software without restriction
x11|x consortium|4|0.85|except as contained in this notice the name of the x consortium shall not be used in advertising
busl-1.1|change date|4|0.85|effective on the change date or the fourth anniversary of the first publicly available distribution
elastic-2.0|hosted or managed service|4|0.85|you may not provide the software to third parties as a hosted or managed service
commons-clause|commons clause|4|0.85|(?:the )?commons clause(?: licen[cs]e)? condition
beerware|beer|4|0.85|if we meet some day and you think this stuff is worth it you can buy me a beer
json|good not evil|4|0.85|the software shall be used for good not evil
gpl|gnu gpl|2|0.6|gnu gpl
lgpl|lgpl|2|0.6|(?:gnu )?lgpl
agpl|agpl|2|0.6|(?:gnu )?agpl
gpl|general public|2|0.6|general public licen[cs]e
apache|apache|2|0.6|apache licen[cs]e
cc|creative commons|1|0.5|creative commons(?: \w+)? licen[cs]e
public-domain|public domain|2|0.6|(?:in|into|to) the public domain
proprietary|all rights reserved|2|0.6|all rights reserved
proprietary|proprietary|2|0.6|proprietary and confidential
other|licen|1|0.3|licen[cs]ed under (?:the )?(?:\w+ ){1,4}licen[cs]e
copyright|copyright|1|0.2|copyright (?:c )?\d{4}
"""


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    weight: float
    regex: re.Pattern


@functools.lru_cache(1)
def rules() -> tuple[Rule, ...]:
    out = []
    forms = [line.split("|", 3) for line in FORMS.strip().splitlines()]
    for line in FAMILIES.strip().splitlines():
        label, keyword, name, ident = line.split("|", 2)[:2] + line.split("|", 2)[2].rsplit("|", 1)
        for _, priority, weight, form in forms:
            of = f"spdx licen" if "ID" in form else keyword
            body = form.replace("ID", ident).replace("NAME", f"(?:{name})")
            out.append(Rule(label, of, int(priority), float(weight), re.compile(f"(?<= ){body}(?= )")))
    for line in TEXTS.strip().splitlines():
        label, keyword, priority, weight, body = line.split("|", 4)
        out.append(Rule(label, keyword, int(priority), float(weight), re.compile(f"(?<= )(?:{body})(?= )")))
    return tuple(out)


@functools.lru_cache(1)
def _keywords() -> tuple[ahocorasick.Automaton, dict[str, list[Rule]]]:
    by: dict[str, list[Rule]] = {}
    for r in rules():
        by.setdefault(r.keyword, []).append(r)
    a = ahocorasick.Automaton()
    for k in by:
        a.add_word(k, k)
    a.make_automaton()
    return a, by


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    rule: Rule


def resolve(found: list[Detection]) -> list[Detection]:
    """In order of priority, length and place: what lies within an accepted interval goes.

    A Fenwick tree over the starts holds the farthest accepted end, so that
    thousands of detections in one text take n log n steps.
    """
    starts = sorted({d.start for d in found})
    far = [0] * (len(starts) + 1)
    kept = []
    for d in sorted(found, key=lambda d: (-d.rule.priority, d.start - d.end, d.start, d.rule.label)):
        i = k = bisect.bisect_right(starts, d.start)
        end = 0
        while k:
            end = max(end, far[k])
            k &= k - 1
        if end >= d.end:
            continue
        kept.append(d)
        while i <= len(starts):
            far[i] = max(far[i], d.end)
            i += i & -i
    return sorted(kept, key=lambda d: (d.start, d.end))


_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normalise(text: str) -> tuple[bytes, int]:
    """The words of a text, lower-cased, a space before and after each; and how many."""
    words = text.encode().translate(_WORDS).split()
    return b" " + b" ".join(words) + b" ", len(words)


def detect(normal: str) -> list[Detection]:
    automaton, by = _keywords()
    hit = {k for _, k in automaton.iter(normal)}
    found = [Detection(m.start(), m.end(), r) for k in sorted(hit) for r in by[k] for m in r.regex.finditer(normal)]
    return resolve(found) if found else []


def scan_text(text: str) -> tuple[int, int, int | None, int | None, str, str, float, str]:
    data, n = normalise(text)
    places, base = [], set()
    for phrase, label in BASE.items():
        needle = b" " + phrase.encode() + b" "
        at = data.find(needle)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = data.find(needle, at + len(needle) - 1)
    first = data.count(b" ", 0, min(places)) if places else None
    last = data.count(b" ", 0, max(places)) if places else None
    found = detect(data.decode())
    labels = base | {d.rule.label for d in found}
    score = max([0.0, *(d.rule.weight for d in found), *([0.7] if base else [])])
    spans = ",".join(f"{d.rule.label}:{d.start}:{d.end}" for d in found)
    return n, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document row: words, places of the base phrases, labels and score.

    In: doc_id, text (further columns are not read). A null or empty text has
    no words: zero counts, null places, empty labels, score 0. detections
    lists the resolved rules as label:start:end over the normalised text.
    score is the greatest weight of what was found. Repeated rows give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, s = pa.int64(), pa.string()
        out = pa.schema([("doc_id", i), ("n_words", i), ("n_base", i), ("first_word", i), ("last_word", i), ("base_labels", s), ("labels", s), ("score", pa.float64()), ("detections", s)])
        for whole in batches:
            for b in pieces(whole):
                rows = [scan_text(t or "") for t in b.column(1).to_pylist()]
                yield arrays(out, [b.column(0), *map(list, zip(*rows, strict=True))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
