"""The pattern rules of op3_url_rules on the hosts planted in the pages."""

import re

from tierspark.llm import queries
from tierspark.llm.url_rules import PatternIndex

SF = "/root/testdata/sf0.01"
SPAM = re.compile(r"(^|\.)(casino-win|free-bets|cheap-pills|adult-x)\.")


def test_planted_hosts_are_blocked_and_clean_ones_allowed(spark):
    rows = [r for r in queries.op3_url_rules(spark, SF).collect() if r.rule is None]
    spam = [r for r in rows if SPAM.search(r.host)]
    assert "free-bets" in {SPAM.search(r.host)[2] for r in spam}
    assert {r.verdict for r in spam} == {"block"}
    assert {r.verdict for r in rows if not SPAM.search(r.host)} == {"allow"}


def test_every_planted_name_has_a_rule():
    index = PatternIndex(queries.PATTERNS, {})
    for name in ("casino-win", "free-bets", "cheap-pills", "adult-x"):
        assert index.find(f"https://m.{name}.example.com/en/1").verdict == "block"


def test_token_index_leaves_few_candidates():
    index = PatternIndex(queries.PATTERNS, {"free": 9, "pills": 5, "adult": 3})
    assert len(queries.PATTERNS) > 200 and all(p.tokens for p in queries.PATTERNS)
    assert len(index.candidates("https://www.free-bets.example.com/en/1")) < 5
    assert index.candidates("https://www.ththon.example.org/en/1") == []


def test_expressions_refuse_what_tokens_fetch():
    """Words in paths of clean hosts, parts of words, and other orders: the token is there, the rule does not fit."""
    index = PatternIndex(queries.PATTERNS, {})
    for url in (
        "https://en.example.org/wiki/poker", "https://film.example.org/casino-royale", "https://a.example.org/?q=casino.example.com",
        "https://betsy.example.org/x", "https://a.example.org/page?login=1", "https://a.example.org/the-login/x",
        "https://a.example.org/calendar/2024", "https://a.example.org/?sid=1", "https://essex.example.org/",
    ):
        assert index.find(url) is None, url
    for url in ("https://pages.example.org/calendar/2024", "https://en.example.org/wiki/poker", "https://a.example.org/?sid=1"):
        assert index.candidates(url), url


def test_each_form_of_rule():
    index = PatternIndex(queries.PATTERNS, {})
    for url in (
        "https://poker.example.org/", "http://x.casino-win.example.com/a", "https://best-slots.example.org", "https://CASINO.example.org/en",
        "https://a.example.org/login", "https://a.example.org/x?PHPSESSID=ab12", "https://a.example.org/calendar/2024/day/7",
        "https://a.example.org/?sid=1&x=2&sid=3", "https://a.example.org/out.php?url=x",
    ):
        assert index.find(url) is not None, url


def test_index_finds_what_trying_every_rule_finds():
    index, names = PatternIndex(queries.PATTERNS, {"casino": 5, "login": 2}), ("poker", "a-bets", "calendar", "login", "sid=1", "x", "porn-")
    urls = [f"https://{a}.example.org/{b}/{c}?{d}" for a in names for b in names for c in names for d in names]
    for url in urls:
        plain = next((p for p in queries.PATTERNS if p.expression.search(url)), None)
        assert index.find(url) == plain, url
