from __future__ import annotations

import itertools
import math

import pytest
from pyspark.sql import functions as F

from concord.llm import urls
from concord.llm.common import table

SCHEMA = "page_id long, url string, html string, host string, odds string"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:stop]


def plain_rule(host, path):
    fitting = []
    for verdict, text in urls.RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fitting.append((len(text), text, verdict))
    return max(fitting)[1:] if fitting else (None, None)


AWKWARD = [
    None, "", "no scheme", "http://", "://A.B/C?d#e", "http://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://x.net",
    "http://x.net/es/1", "http://notexample.com/en/", "a://b://c/d", "http://com/", "http://com?x/", "http://x.net/fr/\nline",
    "http://www.example.com/de/", "http://thequickfox.org/es/9", "http://ÄÖ.example.com/en/", "http://" + "a" * 3000 + ".org/q",
]


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_parts_and_rules(spark, which):
    if which == "awkward":
        pages = spark.createDataFrame([(i, u, None, "x", "y") for i, u in enumerate(AWKWARD + AWKWARD)], SCHEMA)
    else:
        pages = table(spark, "/root/testdata/sf0.01", "pages")
    rows = {(r.page_id, r.url) for r in pages.collect()}
    found = urls.judge(pages).collect()
    assert len(found) == pages.count()
    by_id = {r.page_id: r for r in found}
    for page_id, url in rows:
        r = by_id[page_id]
        assert (r.host, r.path) == plain_parts(url)
        rule, verdict = plain_rule(r.host, r.path)
        assert r.rule == rule and r.verdict in ("allow", "block")
        if verdict:
            assert r.verdict == verdict


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_best_split_against_all_splits():
    words = {"the": 2.0, "he": 2.5, "quick": 4.0, "fox": 4.5, "qui": 6.0, "ck": 6.0, "thequick": 9.0}
    unknown = 5.0
    for run in ("thequickfox", "xthefoxy", "quickthe", "zzz", "a"):
        at = [(i, len(w), c) for w, c in words.items() for i in range(len(run)) if run.startswith(w, i)]
        got = urls.best_split(run, *([x[k] for x in at] for k in range(3)), unknown)
        assert "".join(got) == run
        best = math.inf
        for cuts in itertools.product((0, 1), repeat=len(run) - 1):
            parts, begin = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(run[begin:i])
                    begin = i
            parts.append(run[begin:])
            best = min(best, sum(words.get(p, unknown if len(p) == 1 else math.inf) for p in parts))
        assert sum(words.get(p, unknown * len(p)) for p in got) == pytest.approx(best)


def test_hosts_are_split_into_the_words_of_the_pages(spark):
    html = "<p>red fox</p>" * 30 + "<script>redfox</script> blue fish"
    pages = spark.createDataFrame([(1, "http://redfox.org/", html, "", ""), (2, "http://bluefish.red.org/x1", html, "", "")], SCHEMA)
    found = {r.page_id: r.words for r in urls.judge(pages).collect()}
    assert found[1] == ["red", "fox", "org"] and found[2] == ["blue", "fish", "red", "org"]


def test_words_decide_where_no_rule_does(spark):
    rules = (("block", "bad.org/"), ("allow", "good.org/"))
    html = "casino poker garden flower " * 20
    rows = [(i, f"http://{'casinopoker' if i % 2 else 'gardenflower'}.{'bad' if i % 2 else 'good'}.org/{i}", html, "", "") for i in range(40)]
    rows += [(100, "http://pokercasino.net/", html, "", ""), (101, "http://flowergarden.net/", html, "", "")]
    found = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, SCHEMA), rules).collect()}
    assert found[100] == (None, "block") and found[101] == (None, "allow")


def test_longest_rule_wins_whatever_the_order(spark):
    for rules in itertools.permutations(urls.RULES[:3]):
        rule, verdict = urls.matched_rule(F.lit("www.example.com"), F.lit("/en/1"), rules)
        row = spark.range(1).select(rule.alias("r"), verdict.alias("v")).first()
        assert (row.r, row.v) == ("www.example.com/en/", "allow")
