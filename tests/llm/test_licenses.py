import random
import re
import time

import pytest

from triplane.llm.licenses import NAMES, RULES, detect, fold, resolve, scan


def ungated(text):
    """Every rule without its keywords."""
    return resolve([(i, m.start(), m.end()) for i, (*_, pattern) in enumerate(RULES) for m in re.finditer(pattern, text, re.IGNORECASE) if m.end() > m.start()])


SAMPLES = [
    ("// SPDX-License-Identifier: MIT", {"MIT"}),
    ("# SPDX-License-Identifier: Apache-2.0\n# Copyright (c) 2020 A. N. Other", {"Apache-2.0", "copyright"}),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", {"Apache-2.0"}),
    ("This is free software under the GNU General Public License, version 3 or later.", {"GPL-3.0"}),
    ("under the GNU Lesser General Public License version 2.1", {"LGPL-2.1"}),
    ("the Affero General Public License, version 3", {"AGPL-3.0"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", {"MIT"}),
    ("Text is available under CC BY-SA 4.0.", {"CC-BY-SA-4.0"}),
    ("see https://creativecommons.org/licenses/by-nc/3.0/", {"CC-BY-NC-3.0"}),
    ("All rights reserved.", {"all-rights-reserved"}),
    ("A quiet walk in the park, with permission of the weather.", set()),
    ("", set()),
]


@pytest.mark.parametrize(("text", "licences"), SAMPLES)
def test_samples(text, licences):
    assert {RULES[r][1] for r, _, _ in detect(text)} == licences


def test_keywords_lose_nothing():
    rng = random.Random(1)
    parts = [t for t, _ in SAMPLES if t] + ["plain words here", "(c) 1999", "MPL 2.0", "Unlicense", "BSD 3-Clause", "zlib License", "WTFPL", "Simplified License", "Change Date: soon", "Reserved Font Name"]
    for _ in range(40):
        text = rng.choice([" ", "\n * ", ". "]).join(rng.sample(parts, 5))
        assert detect(text) == ungated(text)


def expanded(pattern):
    """All texts that a pattern's alternatives and optional parts spell, with a mark for what isn't a fixed character."""
    from re import _parser

    def one(op, arg):
        name = str(op)
        if name == "LITERAL":
            return {chr(arg)}
        if name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) < 3:
            return {chr(a) for _, a in arg}
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            return {""}
        if name == "SUBPATTERN":
            return many(arg[-1])
        if name == "BRANCH":
            return set().union(*map(many, arg[1]))
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, body = arg
            return ({""} if not least else set()) | (many(body) if (least, most) in ((0, 1), (1, 1)) else {"\0"})
        return {"\0"}

    def many(parsed):
        out = {""}
        for op, arg in parsed:
            out = {a + b for a in out for b in one(op, arg)}
            assert len(out) < 1_000_000
        return out

    return many(_parser.parse(pattern, re.IGNORECASE))


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r[0])
def test_every_match_holds_a_keyword(rule):
    _, _, _, keys, pattern = rule
    assert all(k == k.lower() for k in keys)
    assert not [x for x in expanded(pattern) if not any(k in x.lower() for k in keys)]


def test_letters_that_only_case_folding_makes_equal():
    for text in ("under the M\u0130T License", "the \u017fIL Open Font License", "Apache L\u0131cense, Version 2.0", "MO\u0417ILLA"):
        assert detect(text) == ungated(text)
    assert fold("\u212aey \u0130\u0131\u017f") == "key iis"


def slow_resolve(found):
    kept = []
    for rule, start, end in sorted(set(found), key=lambda d: (-RULES[d[0]][2], d[1] - d[2], d[1], d[0])):
        if not any(s <= start and end <= e or start <= s and e <= end for _, s, e in kept):
            kept.append((rule, start, end))
    return sorted(kept, key=lambda d: (d[1], d[2], d[0]))


def test_resolve_is_the_plain_rule():
    rng = random.Random(4)
    for _ in range(300):
        found = [(rng.randrange(len(RULES)), s, s + rng.randint(1, 12)) for s in (rng.randrange(40) for _ in range(rng.randint(0, 40)))]
        assert resolve(found) == slow_resolve(found)
    lines = "Copyright (c) 2020 A. N. Other\n" * 100_000
    began = time.perf_counter()
    assert len(detect(lines)) == 100_000 and time.perf_counter() - began < 30


def test_many_rules_and_every_name_is_reachable():
    assert len(RULES) >= 200
    assert len({name for name, *_ in RULES}) == len(RULES)
    for licence, _, _ in NAMES:
        assert RULES[detect(f"SPDX-License-Identifier: {licence}")[0][0]][1] == licence


def test_containment():
    kept = detect("Licensed under the MIT License")
    assert [RULES[r][0].split(":")[0] for r, _, _ in kept] == ["notice"]
    low, high = len(RULES) - 1, 0
    assert resolve([(low, 0, 10), (high, 2, 5)]) == [(high, 2, 5)]  # the higher priority suppresses what contains it
    assert resolve([(low, 0, 4), (high, 2, 8)]) == [(low, 0, 4), (high, 2, 8)]  # overlap alone suppresses nothing


def test_whole_table(spark, make_docs, odd_rows):
    long = "x " * 200_000 + "Licensed under the MIT License"
    rows = odd_rows + [(100 + i, t, "en", "a") for i, (t, _) in enumerate(SAMPLES)] + [(None, "All rights reserved", "en", "a"), (200, long, "en", "a"), (200, long, "en", "a")]
    got = sorted(((r["doc_id"], r["rule"], r["license"], r["priority"], r["start"], r["end"], r["matched"]) for r in scan(make_docs(rows)).collect()), key=repr)
    want = sorted(((i, *RULES[r][:3], s, e, t[s:e]) for i, t, *_ in rows for r, s, e in detect(t)), key=repr)
    assert got == want and sum(g[0] == 200 for g in got) == 2
    assert scan(make_docs([])).collect() == []
