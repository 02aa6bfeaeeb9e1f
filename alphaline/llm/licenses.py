"""License scan by ordered signature rules.

A text becomes its lower-cased words, each with a blank on either side, and hundreds of regular
expressions over words (``rules()``) look for license tags, sentences, notices, names and
abbreviations. One Aho-Corasick pass over the text finds which keywords it holds; only rules with
such a keyword run. Every match is a detection (label, first word, word after the last). A
detection goes if another one of higher rank covers all of its words: a rank is the rule's
priority, then the longer detection, then the earlier rule. So ``gpl-3.0`` in a notice silences the
bare ``gpl`` inside it, and two licenses side by side both stay.

Base phrases (``BASE``) are counted at every place, apart from the rules, and never silenced.

The work is one map over the rows: no shuffle, and a worker holds one text at a time.

Defined results: a null or empty text has no words and no label (empty strings, score 0, null
places); texts of any length are read whole; equal ranks can't meet, as rules are numbered; rows
are judged one by one, so null and repeated ids and equal rows change nothing; an empty table
gives an empty result; other columns of the table are not read, so they may have any name.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaline.llm.textcore import folded_words

#: Phrases that are counted wherever their words stand consecutively, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Class of a rule -> priority (lower goes first) and confidence.
CLASSES = {"tag": (1, 1.0), "text": (2, 0.95), "notice": (3, 0.9), "name": (4, 0.8), "short": (5, 0.6), "hint": (6, 0.4)}

#: label; versions; full names; abbreviations. Names are expressions over words.
FAMILIES = r"""
afl;1.1|1.2|2.0|2.1|3.0;academic free license;afl
agpl;1.0|3.0;(?:gnu )?affero general public license;(?:gnu )?agpl
apache;1.0|1.1|2.0;apache(?: software)?(?: foundation)? license;apache|asl
apsl;1.0|1.1|1.2|2.0;apple public source license;apsl
artistic;1.0|2.0;(?:perl )?artistic license;artistic
bsl;1.1;business source license;busl
boost;1.0;boost software license;bsl
cddl;1.0|1.1;common development and distribution license;cddl
cecill;1.0|1.1|2.0|2.1;cecill(?: free software)? license(?: agreement)?;cecill
cpal;1.0;common public attribution license;cpal
cpl;1.0;common public license;cpl
ecl;1.0|2.0;educational community license;ecl
epl;1.0|2.0;eclipse public license;epl
eupl;1.0|1.1|1.2;european union public licen[cs]e;eupl
fdl;1.1|1.2|1.3;(?:gnu )?free documentation license;(?:gnu )?gfdl|gnu fdl
gpl;1.0|2.0|3.0;(?:gnu )?general public licen[cs]e;(?:gnu )?gpl
ipl;1.0;ibm public license;ipl
lgpl;2.0|2.1|3.0;(?:gnu )?(?:lesser|library) general public licen[cs]e;(?:gnu )?lgpl
lppl;1.0|1.1|1.2|1.3;latex project public license;lppl
mpl;1.0|1.1|2.0;mozilla public license;mpl
mspl;none;microsoft public license;ms pl
msrl;none;microsoft reciprocal license;ms rl
nasa;1.3;nasa open source agreement;nosa
ncsa;none;university of illinois(?: ncsa)? open source license;uiuc license|ncsa license
npl;1.0|1.1;netscape public license;npl
odbl;1.0;(?:odc )?open (?:data commons )?(?:open )?database license;odbl
odcby;1.0;open data commons attribution license;odc by
ofl;1.0|1.1;(?:sil )?open font license;ofl
ogl;1.0|2.0|3.0;open government licen[cs]e;ogl
osl;1.0|1.1|2.0|2.1|3.0;open software license;osl
pddl;1.0;(?:odc )?public domain dedication and license;pddl
php;3.0|3.01;php license;php lic
postgresql;none;postgresql licen[cs]e;postgres license
psf;2.0;python software foundation license|psf license(?: agreement)?;psfl
qpl;1.0;q public license;qpl
ruby;none;ruby license;ruby licence
sleepycat;none;sleepycat license;sleepycat
sspl;1.0;server side public license;sspl
sunpl;1.0;sun public license;spl
unicode;none;unicode(?: inc)? license agreement(?: data files and software)?;unicode dfs
upl;1.0;universal permissive license;upl
vim;none;vim license;vim licence
w3c;none;w3c software(?: notice and)? license;w3c license
watcom;1.0;sybase open watcom public license;watcom license
wtfpl;none;do what the (?:fuck|f ck|f) you want to public license;wtfpl
zlib;none;zlib(?: libpng)? license;zlib license
zpl;1.1|2.0|2.1;zope public license;zpl
cc-by;1.0|2.0|2.5|3.0|4.0;creative commons attribution(?: international| unported| generic)?(?: public)?(?: license)?;cc by|creative commons by
cc-by-sa;1.0|2.0|2.5|3.0|4.0;creative commons attribution share ?alike(?: international| unported| generic)?(?: public)?(?: license)?;cc by sa
cc-by-nc;1.0|2.0|2.5|3.0|4.0;creative commons attribution non ?commercial(?: international| unported| generic)?(?: public)?(?: license)?;cc by nc
cc-by-nd;1.0|2.0|2.5|3.0|4.0;creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: international| unported| generic)?(?: public)?(?: license)?;cc by nd
cc-by-nc-sa;1.0|2.0|2.5|3.0|4.0;creative commons attribution non ?commercial share ?alike(?: international| unported| generic)?(?: public)?(?: license)?;cc by nc sa
cc-by-nc-nd;1.0|2.0|2.5|3.0|4.0;creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: international| unported| generic)?(?: public)?(?: license)?;cc by nc nd
cc0;1.0;creative commons (?:zero|cc0)(?: universal)?(?: public domain dedication)?;cc0|cc zero
mit;none;(?:mit|expat|x11)(?: x11)? licen[cs]e;mit style|expat license
isc;none;isc(?: internet systems consortium)? licen[cs]e|internet systems consortium license;isc licensed
bsd-2-clause;none;(?:2|two) clause bsd licen[cs]e|simplified bsd licen[cs]e|freebsd license;bsd 2 clause|bsd 2
bsd-3-clause;none;(?:3|three) clause bsd licen[cs]e|(?:new|modified|revised) bsd licen[cs]e;bsd 3 clause|bsd 3
bsd-4-clause;none;(?:4|four) clause bsd licen[cs]e|original bsd licen[cs]e;bsd 4 clause|bsd 4
bsd;none;bsd(?: style)? licen[cs]e|berkeley software distribution license;bsd licensed
unlicense;none;the unlicense;unlicense
""".strip()

#: class; label; keyword; expression over words: sentences and hints that no family has.
SENTENCES = r"""
text;mit;free of charge;permission is hereby granted free of charge to any person obtaining a copy of this software
text;mit;the above copyright notice and this;the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
text;mit;merchantability;the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
text;isc;permission to use copy;permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
text;bsd;redistribution and use;redistribution and use in source and binary forms with or without modification are permitted
text;bsd;redistributions of source;redistributions of source code must retain the above copyright notice
text;bsd;redistributions in binary;redistributions in binary form must reproduce the above copyright notice
text;bsd-3-clause;endorse or promote;neither the name of(?: the)?(?: [^ ]+){1,8} nor the names of its contributors may be used to endorse or promote products
text;bsd-4-clause;advertising materials;all advertising materials mentioning features or use of this software must display
text;apache-2.0;except in compliance;you may not use this file except in compliance with the license
text;apache-2.0;limitations under the license;see the license for the specific language governing permissions and limitations under the license
text;gpl;redistribute it and or modify;this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
text;lgpl;redistribute it and or modify;this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
text;gpl;without even the implied;but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
text;gpl-2.0;2 of the license;version 2 of the license(?: or at your option any later version)?
text;gpl-3.0;3 of the license;version 3 of the license(?: or at your option any later version)?
text;gpl-exception;linking exception;(?:classpath|gcc runtime library|font|linking) (?:linking )?exception
text;mpl-2.0;source code form;this source code form is subject to the terms of the mozilla public license v 2 0
text;mpl-1.1;contents of this file;the contents of this file are subject to the mozilla public license
text;epl;accompanying materials;this program and the accompanying materials are made available under the terms of the eclipse public license
text;boost-1.0;obtaining a copy of the software;permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
text;zlib;altered source;altered source versions must be plainly marked as such
text;zlib;origin of this software;the origin of this software must not be misrepresented
text;unlicense;unencumbered;this is free and unencumbered software released into the public domain
text;wtfpl;what the;you just do what the (?:fuck|f ck|f) you want to
text;ofl-1.1;font software;permission is hereby granted free of charge to any person obtaining a copy of the font software
text;fdl;invariant sections;with no invariant sections no front cover texts and no back cover texts
text;cc0-1.0;waived all copyright;(?:has )?waived all copyright and related or neighboring rights
text;artistic-2.0;standard version;you may distribute(?: [^ ]+){0,6} copies of the standard version
text;json;good not evil;shall be used for good not evil
text;openssl;openssl toolkit;this product includes software developed by the openssl project for use in the openssl toolkit
text;sspl-1.0;functionality of the program;make the functionality of the program(?: or a modified version)? available to third parties as a service
text;commons-clause;commons clause;commons clause(?: license)?(?: condition)?
text;elastic-2.0;elastic license;elastic license(?: 2 0)?
text;polyform;polyform;polyform (?:noncommercial|small business|shield|strict|perimeter)(?: license)?
text;openrail;openrail;(?:creativeml|bigscience|bigcode) (?:open ?rail|openrail) ?(?:m|plus plus)?(?: license)?
text;llama;community license;(?:meta )?llama [0-9](?: [0-9])? community license(?: agreement)?
notice;cc-by;attribution to;you must give(?: the)? (?:appropriate credit|attribution to)
notice;no-commercial;commercial;(?:for )?(?:non ?commercial|not for commercial)(?: [^ ]+){0,2} (?:use|purposes) only
notice;no-commercial;may not be used for commercial;may not be used for commercial purposes
notice;no-redistribution;redistribut;(?:do not|may not be|must not be)(?: [^ ]+){0,3} (?:redistribute|redistributed)
notice;research-only;research;for(?: [^ ]+){0,3} research(?: [^ ]+){0,2} (?:use|purposes) only
notice;no-training;training;(?:may|must|shall) not be used(?: [^ ]+){0,6} (?:training|train)
notice;no-training;text and data mining;(?:reserved|opt out|prohibited)(?: [^ ]+){0,6} text and data mining
notice;proprietary;proprietary;(?:proprietary and confidential|confidential and proprietary)
notice;proprietary;unauthorized;unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: [^ ]+){0,8} (?:prohibited|forbidden)
notice;proprietary;reproduced;no part of this(?: [^ ]+){1,4} may be reproduced
notice;proprietary;written permission;without(?: the)?(?: prior| express| explicit)*(?: written)? (?:permission|consent) of(?: the)? (?:publisher|author|copyright (?:holder|owner)|owner)s?
notice;proprietary;end user license;end user licen[cs]e agreement
notice;reserved;rights reserved;(?:some|no|all) rights reserved(?: worldwide)?
notice;public-domain;public domain;(?:released|placed|dedicated|is)(?: [^ ]+){0,3} (?:in|into|to) the public domain
hint;public-domain;public domain;public domain
hint;copyleft;copyleft;copyleft
hint;copyright;copyright;copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
hint;proprietary;proprietary;proprietary(?: software| licen[cs]e)
hint;shareware;shareware;shareware
hint;freeware;freeware;freeware
hint;open-source;open source;open source (?:software|licen[cs]e|project)
hint;creative-commons;creative commons;creative commons(?: licen[cs]e)?
hint;dual-license;dual;dual licen[cs]ed(?: under)?
hint;trademark;trademark;(?:registered )?trademarks? of
hint;patent;patent;patent(?:s)? (?:pending|granted|licen[cs]e|grant)
hint;license-unknown;licen;(?:licensed|released|distributed)(?: [^ ]+){0,2} under(?: [^ ]+){1,6} licen[cs]e
""".strip()

_GIVEN = "(?:licensed|released|distributed|available|published|provided|shared|covered|offered|governed)(?: [^ ]+){0,2} (?:under|by)(?: the)?(?: terms of(?: the)?)? "
_LETTERS = re.compile(r"[a-z0-9]+(?: [a-z0-9]+)*")


class Rule(NamedTuple):
    """One signature: its class's priority and confidence, the label, its keywords (any of them) and expression."""

    priority: int
    confidence: float
    label: str
    keywords: tuple[str, ...]
    pattern: str


def _family(line: str) -> Iterator[Rule]:
    """A family's rules: tags, notices, names and abbreviations, by version and without one."""
    label, versions, full, short = line.split(";")
    keywords = tuple(sorted({max(_LETTERS.findall(re.sub(r"\(\?:[^()]*\)\??|\[[^]]*\]|[a-z0-9 ]\?", "|", one)), key=len) for one in [*_alternatives(full), *_alternatives(short)]}))
    full, short = f"(?:{full})", f"(?:{short})"
    for version in [*([] if versions == "none" else versions.split("|")), None]:
        if version is None:
            name, long, brief = label, full, short
        else:
            number = version.replace(".", " ").removesuffix(" 0") + ("(?: 0)?" if version.endswith(".0") else "")
            name, long, brief = f"{label}-{version}", f"{full}(?: version| ver| v)?(?: | v){number}", f"{short}(?:(?: version| ver| v)? | ?v){number}"
        for kind, pattern in (("tag", f"spdx license identifier (?:{long}|{brief})(?: only| or later)?"), ("notice", f"{_GIVEN}(?:{long}|{brief})"), ("name", long), ("short", brief)):
            yield Rule(*CLASSES[kind], name, keywords, pattern)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in their order."""
    found = [rule for line in FAMILIES.split("\n") for rule in _family(line)]
    for line in SENTENCES.split("\n"):
        kind, label, keyword, pattern = line.split(";")
        found.append(Rule(*CLASSES[kind], label, (keyword,), pattern))
    return tuple(found)


def _alternatives(expression: str) -> list[str]:
    """The alternatives of an expression's top level."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(expression):
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            parts.append(expression[last:i])
            last = i + 1
    return [*parts, expression[last:]]


def spaced(pattern: str) -> str:
    """An expression over words as one over the spaced text, where every word has a blank on either side."""
    return " (?:" + pattern.replace("[^ ]", "\0").replace(" ?", "\1").replace(" ", "  ").replace("\0", "[^ ]").replace("\1", "(?:  )?") + ") "


@cache
def _machine() -> tuple[ahocorasick.Automaton, list[list[int]], list[re.Pattern]]:
    """The automaton of keywords, the rules of each keyword, and the rules' expressions."""
    keywords = sorted({k for r in rules() for k in r.keywords})
    automaton = ahocorasick.Automaton()
    for no, keyword in enumerate(keywords):
        automaton.add_word(keyword.replace(" ", "  "), no)
    automaton.make_automaton()
    number = {k: i for i, k in enumerate(keywords)}
    gated: list[list[int]] = [[] for _ in keywords]
    for no, rule in enumerate(rules()):
        for keyword in rule.keywords:
            gated[number[keyword]].append(no)
    return automaton, gated, [re.compile(spaced(r.pattern)) for r in rules()]


class Scan(NamedTuple):
    """What a text holds: words, base places ``(first word, label)``, detections ``(first word, word after the last, rule)``."""

    n_words: int
    base: list[tuple[int, str]]
    kept: list[tuple[int, int, int]]


def unsilenced(found: list[tuple[int, int, int]], known: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """Detections that no other one of higher rank covers.

    In the order of rank, a detection stays unless one that stays begins no later and ends no
    earlier; a tree of largest ends by first word answers that in logarithmic time.
    """
    if len(found) < 2:
        return found
    firsts = sorted({d[0] for d in found})
    ends = [0] * (len(firsts) + 1)
    kept = []
    for first, stop, rule in sorted(found, key=lambda d: (known[d[2]].priority, d[0] - d[1], d[2], d[0])):
        at, reach = bisect_right(firsts, first), 0
        i = at
        while i:
            reach, i = max(reach, ends[i]), i & (i - 1)
        if reach >= stop:
            continue
        kept.append((first, stop, rule))
        while at < len(ends):
            ends[at] = max(ends[at], stop)
            at += at & -at
    return sorted(kept)


def scan_text(text: str | None) -> Scan:
    """The scan of one text."""
    words = folded_words(text)
    if not words:
        return Scan(0, [], [])
    joined = b"".join([b" ", b"  ".join(words), b" "]).decode()
    automaton, gated, patterns = _machine()
    hits = {no for _, no in automaton.iter(joined)}
    base = [(m.start(), label) for phrase, label in BASE.items() for m in re.finditer(f"(?=({spaced(phrase)}))", joined)] if any(p.replace(" ", "  ") in joined for p in BASE) else []
    spans = [(*m.span(), rule) for rule in {r for no in hits for r in gated[no]} for m in patterns[rule].finditer(joined)]
    if not base and not spans:
        return Scan(len(words), [], [])
    places = list(accumulate((len(w.decode()) + 2 for w in words), initial=0))
    word_at = {p: i for i, p in enumerate(places)} if len(spans) + len(base) > len(words) // 8 else None
    at = word_at.__getitem__ if word_at else lambda p: bisect_right(places, p) - 1
    kept = unsilenced([(at(a), at(b), rule) for a, b, rule in spans], rules())
    return Scan(len(words), sorted((at(a), label) for a, label in base), kept)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = rules()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64()]
    for batch in batches:
        rows = []
        for text in batch.column(1):
            scan = scan_text(text.as_py())
            base = {label for _, label in scan.base}
            best = max((known[rule].confidence for _, _, rule in scan.kept), default=0.0)
            rows.append((
                scan.n_words, len(scan.base), scan.base[0][0] if scan.base else None, scan.base[-1][0] if scan.base else None,
                ",".join(sorted(base)), ",".join(sorted(base | {known[rule].label for _, _, rule in scan.kept})),
                max(best, CLASSES["hint"][1] if base else 0.0), len(scan.kept),
            ))
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[batch.schema.names[0], *names])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = rules()
    for batch in batches:
        for i, text in enumerate(batch.column(1)):
            scan = scan_text(text.as_py())
            for a in range(0, len(scan.kept), 10_000):
                part = scan.kept[a : a + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([batch.column(0).slice(i, 1)] * len(part)), pa.array([known[r].label for *_, r in part]), pa.array([r for *_, r in part], pa.int32()), pa.array([known[r].confidence for *_, r in part]),
                        pa.array([d[0] for d in part], pa.int64()), pa.array([d[1] - 1 for d in part], pa.int64()),
                    ],
                    names=[batch.schema.names[0], "label", "rule", "confidence", "first_word", "last_word"],
                )


def _source(docs: DataFrame, key: str) -> tuple[DataFrame, str]:
    chosen = docs.select(F.col(key), F.col("text").cast("string").alias("__text"))
    return chosen, f"`{key}` {chosen.schema[0].dataType.simpleString()}"


def detections(docs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """A row for each detection that stays: label, rule's number, confidence, first and last word."""
    chosen, first = _source(docs, key)
    return chosen.mapInArrow(_rows, f"{first}, label string, rule int, confidence double, first_word bigint, last_word bigint")


def license_report(docs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Words, base places, labels and score of each document.

    The score is the largest confidence of a detection that stays; a base phrase counts as a hint.
    """
    chosen, first = _source(docs, key)
    return chosen.mapInArrow(_report, f"{first}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_detections bigint")


def _oracle() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    table = ",\n  ".join(f"({no}, {r.priority}, {r.confidence}::DOUBLE, {quoted(r.label)}, {quoted(spaced(r.pattern))})" for no, r in enumerate(rules()))
    keywords = ", ".join(f"({quoted(k.replace(' ', '  '))}, {[no for no, r in enumerate(rules()) if k in r.keywords]})" for k in sorted({k for r in rules() for k in r.keywords}))
    base = ", ".join(f"({-no}, 0, 0::DOUBLE, {quoted(label)}, {quoted(spaced(phrase))})" for no, (phrase, label) in enumerate(BASE.items(), 1))
    return rf"""
WITH rule(no, priority, confidence, label, pattern) AS (VALUES {table}, {base}),
gate(keyword, nos) AS (VALUES {keywords}),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
txt AS (SELECT r, ' ' || array_to_string(w, '  ') || ' ' AS t FROM doc WHERE len(w) > 0),
open AS (SELECT DISTINCT r, unnest(nos) AS no FROM txt JOIN gate ON contains(t, keyword) UNION ALL SELECT r, no FROM txt, rule WHERE no < 0),
gated AS (SELECT r, no, priority, confidence, label, regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS s FROM open JOIN txt USING (r) JOIN rule USING (no)),
hit AS (SELECT r, no, priority, confidence, label, m[i] AS m, array_to_string(list_transform(range(1, i), lambda j: s[j] || m[j]), '') || s[i] AS before FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM gated)),
det AS (SELECT r, no, priority, confidence, label, a, a + len(string_split(trim(m), '  ')) AS b FROM (SELECT *, CASE WHEN before = '' THEN 0 ELSE len(string_split(trim(before), '  ')) END AS a FROM hit)),
kept AS (SELECT r, label, confidence FROM det d WHERE no >= 0 AND NOT EXISTS (SELECT 1 FROM det e WHERE e.no >= 0 AND e.r = d.r AND e.a <= d.a AND e.b >= d.b AND (e.priority, e.a - e.b, e.no) < (d.priority, d.a - d.b, d.no))),
place AS (SELECT r, a AS i, label FROM det WHERE no < 0),
told AS (SELECT r, count(*) AS n_detections, max(confidence) AS best FROM kept GROUP BY r),
based AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY r),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM place UNION SELECT r, label FROM kept) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(coalesce(best, 0), CASE WHEN n_base > 0 THEN {CLASSES["hint"][1]} ELSE 0 END)::DOUBLE AS score, coalesce(n_detections, 0) AS n_detections
FROM doc LEFT JOIN told ON told.r = doc.r LEFT JOIN based ON based.r = doc.r LEFT JOIN named ON named.r = doc.r
"""


ORACLE = _oracle()
