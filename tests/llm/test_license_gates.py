"""License rules: gates lose no detection, suppression is containment, and known wordings get their labels."""

import random
import re
from re import _parser

import pytest

from corvid.llm import license_rules


def example(parsed, rng):
    """A text that a parsed pattern matches."""
    out = ""
    for op, x in parsed:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(x)
        elif kind == "BRANCH":
            out += example(rng.choice(x[1]), rng)
        elif kind == "SUBPATTERN":
            out += example(x[3], rng)
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, own = x
            out += "".join(example(own, rng) for _ in range(rng.randint(low, min(high, low + 2))))
        elif kind == "IN":
            of, first = x[0]
            out += "x" if str(of) == "NEGATE" else chr(first[0] if str(of) == "RANGE" else first)
        elif kind == "NOT_LITERAL":
            out += "x"
        elif kind not in ("AT", "ASSERT", "ASSERT_NOT"):
            raise ValueError(kind)
    return out


def one_example(rule, rng):
    return re.sub(" +", " ", example(_parser.parse(rule.pattern.pattern.decode()), rng)).strip().encode()


def test_every_rule_finds_its_own_examples():
    rng = random.Random(3)
    for rule in license_rules.rules():
        for _ in range(12):
            text = one_example(rule, rng)
            assert rule.pattern.search(text), (rule.name, text)
            assert any(k in text for k in rule.keywords), (rule.name, text)
            assert license_rules.detect(text), (rule.name, text)


def test_patterns_are_distinct():
    patterns = [r.signature for r in license_rules.rules()]
    assert len(patterns) == len(set(patterns)) > 400 and len(license_rules.WORDINGS.strip().splitlines()) > 120


def slow_detect(text):
    """All rules without a gate; a detection stays unless one of higher rank that stays holds it."""
    found = license_rules.detections(text, set(range(len(license_rules.rules()))))
    found.sort(key=lambda x: (-x.priority, x.start, -x.end, -x.confidence, x.rule))
    kept = []
    for x in found:
        if not any(y.start <= x.start and x.end <= y.end for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x.start, x.end))


@pytest.mark.parametrize("seed", range(25))
def test_gates_and_suppression_against_all_rules(seed):
    rng = random.Random(seed)
    rules, parts = license_rules.rules(), []
    for _ in range(rng.randint(1, 12)):
        text = one_example(rng.choice(rules), rng).decode().split()
        a, b = sorted((rng.randint(0, len(text)), rng.randint(0, len(text))))
        parts += rng.choice([text, text, text[a:b]]) + rng.choice([[], ["some", "words"], ["or"], ["license"]])
    text = " ".join(parts).encode()
    assert license_rules.detect(text) == slow_detect(text)


@pytest.mark.parametrize(("text", "labels"), [
    ("released under Creative Commons BY-SA 4.0", "cc-by-sa-4"),
    ("see the proprietary notice", "proprietary"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
    ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd-3"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3-or-later"),
    ("GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "lgpl-2.1-or-later"),
    ("SPDX-License-Identifier: Apache-2.0 OR MIT", "apache-2,mit"), ("Apache-2.0 OR MIT", "apache-2,mit"), ("MIT OR Apache-2.0", "apache-2,mit"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2-or-later"), ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "classpath-exception-2,gpl-2"),
    ("released under the GPL v2 or later", "gpl-2-or-later"), ("GPLv3", "gpl-3"), ("Licensed under the Apache License, Version 2.0", "apache-2"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
    ("To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights", "cc0-1"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"), ("mit dem Hund oder mit der Katze", ""), ("", ""),
])
def test_known_wordings(text, labels):
    assert license_rules.scan(text.encode())["labels"] == labels


def test_a_long_text_with_many_hits_is_linear():
    text = b"licensed under the Apache License, Version 2.0 and CC BY-NC 4.0. " * 20_000
    got = license_rules.scan(text)
    assert got["n_base"] == 40_000 and (got["first_word"], got["last_word"]) == (3, got["n_words"] - 5) and got["labels"] == "apache-2,cc-by-nc,cc-by-nc-4"
