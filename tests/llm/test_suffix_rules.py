"""Registered domains by a table of suffix rules (operator 10)."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quadrat.llm import url_reputation

RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "or.jp", "jp", "*.city.jp", "!town.city.jp", "github.io", "io", " ", "CO.UK"]


def plain(host, rules):
    """(domain, suffix) by testing every rule."""
    labels, fits = host.split("."), []
    for rule in (r.strip().lower() for r in rules):
        own = rule.lstrip("!").split(".")
        if rule and len(own) <= len(labels) and all(a in ("*", b) for a, b in zip(own, labels[len(labels) - len(own) :])):
            fits.append((rule.startswith("!"), len(own) - rule.startswith("!")))
    k = max(fits, default=(False, 1))[1]
    return ".".join(labels[-k - 1 :]), ".".join(labels[-k:])


def levels(spark, hosts, rules):
    r = spark.createDataFrame([(r,) for r in rules], "rule string")
    got = url_reputation.with_ruled_levels(spark.createDataFrame([(h, i) for i, h in enumerate(hosts)], "host string, n int"), r).collect()
    return {x["n"]: (x["domain"], x["suffix"]) for x in got}


def test_rules_wildcards_and_exceptions(spark):
    hosts = ["a.b.co.uk", "www.ck", "a.www.ck", "b.other.ck", "other.ck", "ck", "x.or.jp", "a.b.c.city.jp", "x.town.city.jp", "me.github.io", "github.io", "a.example.com", "localhost", "", "10.0.0.1", "a.b.co.uk", "." * 500 + "com"]
    got = levels(spark, hosts, RULES)
    assert got == {i: plain(h, RULES) for i, h in enumerate(hosts)}
    named = {h: got[i] for i, h in enumerate(hosts)}
    assert named["me.github.io"] == ("me.github.io", "github.io") and named["a.www.ck"] == ("www.ck", "ck") and named["b.other.ck"] == ("b.other.ck", "other.ck")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=5).map(".".join), min_size=1, max_size=30), st.lists(st.tuples(st.sampled_from(["", "*.", "!"]), st.lists(st.sampled_from("abc"), min_size=1, max_size=3).map(".".join)).map("".join).filter(lambda r: not (r[0] == "!" and "." not in r)), max_size=8))
def test_any_rules_equal_the_plain_test(spark, hosts, rules):
    assert levels(spark, hosts, rules) == {i: plain(h, rules) for i, h in enumerate(hosts)}


@pytest.mark.parametrize("host, n", [("h", 1), (None, 1)])
def test_no_rules_and_null_hosts(spark, host, n):
    assert levels(spark, [host], []) == {0: (host, host)}


def test_pages_share_the_prior_of_their_ruled_domain(spark):
    pages = spark.createDataFrame([(i, f"http://{h}/{i}") for i, h in enumerate(["a.or.jp"] * 40 + ["b.or.jp"] * 40 + ["x.a.or.jp"])], "page_id long, url string")
    marks = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "page_id long, bad int")
    rules = spark.createDataFrame([("or.jp",), ("jp",)], "rule string")
    by_rules = {r["host"]: r["bad_share"] for r in url_reputation.judge(pages, marks, rules=[], suffixes=rules).collect()}
    by_list = {r["host"]: r["bad_share"] for r in url_reputation.judge(pages, marks, rules=[]).collect()}
    assert by_rules["x.a.or.jp"] > 0.8 and abs(by_list["x.a.or.jp"] - 0.5) < 0.1  # else all are of one domain, or.jp
    plan = url_reputation.with_ruled_levels(pages.selectExpr("'a' AS host"), rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
