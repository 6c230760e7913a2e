"""URL rules and vocabulary held against plain definitions."""

import random
import re

import pytest

from corvid.llm import url_filter
from corvid.llm.url_filter import RULES, VOCABULARY, Judge, Rule, Vocabulary, host_and_path, judge_urls


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        (None, "", ""), ("", "", ""), ("no scheme/x", "", ""), ("http://A.Org", "a.org", ""), ("http://A.Org/X?y#z", "a.org", "/X"), ("x://h?q=/a/b", "h", ""), ("x://h#/a?b", "h", ""),
        ("a://b://c/d", "b:", "//c/d"), ("://h/p", "h", "/p"), ("http:///p", "", "/p"), ("http://É.org:80/é", "É.org:80", "/é"), ("http://u@h/a\nb", "u@h", "/a\nb"),
    ],
)
def test_host_and_path(url, host, path):
    assert host_and_path(url) == (host, path)


@pytest.mark.parametrize(
    ("url", "rule", "verdict"),
    [
        ("http://x.org/a", "org/", "allow"), ("http://org/a", "org/", "allow"), ("http://xorg/a", None, "allow"), ("http://x.org", None, "allow"),
        ("http://m.example.org/es/1", "example.org/es/", "block"), ("http://example.org/en/17", "example.org/en/1", "block"), ("http://notexample.org/es/1", "org/", "allow"),
        ("http://example.org/en/27", "org/", "allow"), ("http://a.com/de/x", "com/de/", "block"), ("http://a.com/fr/porn", "com/fr/", "allow"), ("http://a.com/en/porn", None, "block"),
        ("http://a.com.net/de/", None, "allow"), ("http://a.COM/DE/", None, "allow"), ("http://a.org:80/", None, "allow"), ("http://.org/", "org/", "allow"),
    ],
)
def test_production_rules(url, rule, verdict):
    got = Judge(RULES, VOCABULARY).judge(url)
    assert (got[2], got[3]) == (rule, verdict)


def test_longest_rule_and_ties():
    rules = (Rule("allow", "org", "/abcd"), Rule("block", "x.org", "/ab"), Rule("allow", "x.org", "/ab"), Rule("block", "org", ""))
    judge = Judge(rules, VOCABULARY)
    assert judge.rule("x.org", "/abcd") is rules[1] and judge.rule("y.org", "/abcd") is rules[0] and judge.rule("y.org", "/z") is rules[3] and judge.rule("a.x.org", "/a") is rules[3]
    assert judge.rule("", "/") is None and judge.rule("org.", "/") is None


def test_boundaries_and_weights():
    judge = Judge((), Vocabulary(frozenset({"bad", "worse"}), {"free": 2, "win": 2, "ad": 1}, frozenset({"worse"}), limit=4))
    verdict = lambda url: judge.judge(url)[3]
    assert verdict("http://h/bad") == verdict("http://h/a-BAD_b") == verdict("bad") == verdict("http://h/xworsey") == "block"
    assert verdict("http://h/badly") == verdict("http://h/1bad") == verdict("http://h/free/free/free") == verdict("http://h/free/ad") == verdict("") == verdict(None) == "allow"
    assert verdict("http://free.h/win") == "block"
    assert judge.judge("http://h/ébad")[4] == ["bad"] and judge.judge("http://h/free-free/ad/bad-bad")[4:] == (["bad"], ["ad", "free"], 5, 7)
    assert Judge((), Vocabulary(frozenset(), {})).judge("http://h/bad")[3] == "allow"


def test_hits_against_expressions():
    rng, judge = random.Random(3), Judge(RULES, VOCABULARY)
    terms = [*VOCABULARY.strict, *VOCABULARY.soft]
    for _ in range(300):
        url = "http://h.net/" + "".join(rng.choice([*terms, *"-/_.xé1"]) for _ in range(rng.randrange(12)))
        want = {t for t in terms if re.search(re.escape(t) if t in VOCABULARY.inside else rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", url)}
        assert set(judge.hits(url)) == want


def test_frame(spark):
    urls = ["http://a.com/de/1", None, "", "nothing", "http://x.net/porn/" + "a" * 2_000_000, "http://a.com/de/1"]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int")
    rows = {r.page_id: r for r in judge_urls(df).collect()}
    assert len(rows) == 6 and rows[0][1:5] == rows[5][1:5] == ("a.com", "/de/1", "com/de/", "block") and rows[1][1:] == ("", "", None, "allow", [], [], 0, 0)
    assert rows[4].verdict == "block" and rows[4].strict == ["porn"] and rows[2].verdict == rows[3].verdict == "allow"
    assert judge_urls(df.limit(0)).count() == 0 and judge_urls(df.union(df)).count() == 12


def test_no_soft_term_blocks_alone():
    assert max(VOCABULARY.soft.values()) < VOCABULARY.limit and not VOCABULARY.strict & VOCABULARY.soft.keys() and VOCABULARY.strict >= VOCABULARY.inside
    assert all(t == t.lower() for t in [*VOCABULARY.strict, *VOCABULARY.soft]) and url_filter.RULES[0].text == "org/"
