import random
import re
import string
from collections import defaultdict

from pyspark.sql import functions as F

from alphaline.llm import licenses
from tests.llm.cases import documents, texts
from tests.oracle import rows

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

EXAMPLES = {
    "Licensed under the Apache License, Version 2.0 (the \"License\")": {"apache-2.0"},
    "SPDX-License-Identifier: GPL-2.0-or-later": {"gpl-2.0"},
    "GNU Lesser General Public License v2.1": {"lgpl-2.1", "gpl"},
    "under the GNU General Public License, version 3": {"gpl-3.0", "gpl"},
    "gplv3 and LGPL v3": {"gpl-3.0", "lgpl-3.0"},
    "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc-4.0"},
    "CC-BY": {"cc-by"},
    "Released under the MIT License.": {"mit"},
    "All rights reserved.": {"reserved"},
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": {"mit"},
    "Redistribution and use in source and binary forms, with or without modification, are permitted": {"bsd"},
    "BSD 3-Clause": {"bsd-3-clause"},
    "This is free and unencumbered software released into the public domain.": {"unlicense"},
    "MPL 2.0 or EPL-1.0": {"mpl-2.0", "epl-1.0"},
    "submit commits; permitted for a limited time": set(),
    "the accb ycc bybye general publicly licensed": set(),
}


def labels(text):
    scan = licenses.scan_text(text)
    return {label for _, label in scan.base} | {licenses.rules()[rule].label for _, _, rule in scan.kept}


def test_examples():
    assert {t: labels(t) for t in EXAMPLES} == EXAMPLES


def mixed(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice([*EXAMPLES, "word", "and the", "GNU", "license 2.0", "cc by", "\n"]) for _ in range(n))


def brute(text):
    """Every rule over the whole text without a gate, then each detection against each other one."""
    w = WORDS.findall((text or "").translate(LOWER))
    joined = " " + "  ".join(w) + " " if w else ""
    at = {}
    for k, word in enumerate(w):
        at[sum(len(x) + 2 for x in w[:k])] = k
    found = []
    for no, rule in enumerate(licenses.rules()):
        for m in re.finditer(licenses.spaced(rule.pattern), joined):
            found.append((at[m.start()], at[m.start()] + len(m[0].split()), no))
    rank = lambda d: (licenses.rules()[d[2]].priority, d[0] - d[1], d[2])
    kept = [d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and rank(e) < rank(d) for e in found)]
    base = sorted((k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
    return len(w), base, sorted(kept)


def test_scan_equals_brute_force():
    for text in [*(mixed(k, 25) for k in range(25)), None, "", "cc by cc by cc", "ÀCC BY cc byé"]:
        assert tuple(licenses.scan_text(text)) == brute(text)


def test_every_keyword_is_part_of_what_its_rule_finds():
    """A gate must not hide a match: each rule's expression without its keywords can't be met by the examples above alone."""
    for text in [mixed(k, 40) for k in range(100, 110)]:
        joined = "".join(f" {w} " for w in WORDS.findall(text.translate(LOWER)))
        for rule in licenses.rules():
            for m in re.finditer(licenses.spaced(rule.pattern), joined):
                assert any(k.replace(" ", "  ") in m[0] for k in rule.keywords), (rule, m[0])


def test_rules_are_many_and_numbered():
    assert len(licenses.rules()) > 300 and len({(r.label, r.pattern) for r in licenses.rules()}) > 300


def test_report_and_detections(spark):
    docs = documents(spark).withColumn("label", F.lit(1)).withColumn("score", F.lit(2))
    extra = [(100, mixed(1, 30)), (100, mixed(1, 30)), (None, "All rights reserved, CC BY"), (101, mixed(2, 4000))]
    docs = docs.select("doc_id", "text", "label", "score").union(spark.createDataFrame([(i, t, 1, 2) for i, t in extra]))
    known = licenses.rules()
    expected = []
    for i, t in [*texts(), *extra]:
        n, base, kept = licenses.scan_text(t)
        own = {label for _, label in base}
        score = max([0.0, *([0.4] if base else []), *(known[r].confidence for *_, r in kept)])
        expected.append((i, n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own | {known[r].label for *_, r in kept})), score, len(kept)))
    found = [tuple(r) for r in licenses.license_report(docs).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    by = defaultdict(list)
    for r in licenses.detections(docs).collect():
        by[r.doc_id].append((r.first_word, r.last_word + 1, r.rule))
    assert sorted(by[101]) == licenses.scan_text(extra[3][1]).kept and len(by[100]) == 2 * len(licenses.scan_text(extra[0][1]).kept)
    assert rows(licenses.license_report(docs.limit(0)).toPandas()) == []
