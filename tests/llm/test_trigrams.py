"""Trigram queries, and secret scans with many rules, by either join and over long texts."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from test_operators import ODD, SECRETS, TRICKY, spans_of

from keyfold.llm import secret_scan
from keyfold.llm.trigrams import ANYTHING, All, Any, flat, holds, named, query_of


def of(text):
    return {text.lower()[i : i + 3] for i in range(len(text) - 2)}


def test_queries_come_from_the_expression():
    api = query_of("api_?key")
    assert api == Any(frozenset({All(frozenset({"api", "pik", "ike", "key"})), All(frozenset({"api", "pi_", "i_k", "_ke", "key"}))}))
    assert query_of("AKIA[A-Z0-9]+") == All(frozenset({"aki", "kia"})) and query_of("[0-9a-f]{24,}") == ANYTHING
    assert query_of("(?i:password|passwd)=x") == Any(frozenset({All(frozenset(of("password=x"))), All(frozenset(of("passwd=x")))}))
    assert query_of("gh[ps]_[a-z]{36}") == Any(frozenset({All(frozenset({"ghp", "hp_"})), All(frozenset({"ghs", "hs_"}))}))
    assert query_of(r"\Qa.b\E\d{3}z{5}") == All(frozenset({"a.b", "zzz"})) and query_of("[^a]bcd") == "bcd"
    for none in (".*", "x|abcd", "[[a-z]&&[def]]", "(abc", "a{,3}", "(?x)a b c", "(abc)?", "(?iu)kelvin", ""):
        assert query_of(none) == ANYTHING
    deep = query_of("abc[0-9]+((de|[0-9]+)fgh|(ij|[0-9]*)klm)")
    assert flat(deep) == [[["abc"]], [["fgh"], ["klm"]]] and flat(query_of("(xyz|[a-z]+)")) == []
    assert {"abc", "xyz"} <= named(query_of("(abc|abd)[a-z]*xyz"))


ATOMS = hs.sampled_from(["a", "b", "c", "Ab", "[ab]", "[a-c]", "[^a]", ".", "\\.", "(?:ab|c)", "(a|bc|)", "(?i:aB)", "b{2}", "c{1,3}", "(?=a)", "[b-]", "a*?"])
PATTERNS = hs.lists(hs.tuples(ATOMS, hs.sampled_from(["", "", "?", "*", "+", "{2}", "{1,2}"])), min_size=1, max_size=6).map(
    lambda parts: "".join(a + (q if not a.endswith(("}", "?", ")")) or a.startswith("(") and a != "(?=a)" else "") for a, q in parts)
)


@settings(max_examples=300, deadline=None)
@given(PATTERNS, hs.text("abcABC.-x", max_size=14))
def test_matches_hold_what_is_asked_for(pattern, text):
    m = re.search(pattern, text)
    if m:
        assert holds(query_of(pattern), of(text))
        assert all(any(set(way) <= of(text) for way in ways) for ways in flat(query_of(pattern)))


def expected(kinds, rows):
    return Counter((i, *[(k, s, e) for k, s, e in spans_of(kinds, t)]) for i, t in rows)


@pytest.mark.parametrize("broadcast", [True, False])
def test_two_hundred_rules_by_either_join(spark, docs, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(secret_scan, "BROADCAST_ROWS", 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    more = [(f"rule{k}", f"key{k:03d}[_-]?{'xyz'[k % 3]}{k}=([a-z]+)") for k in range(200)]
    rules = secret_scan.BASE + tuple(secret_scan.Rule(name, pattern, 1, 3) for name, pattern in more)
    assert len(frozenset().union(*(named(r.query) for r in rules))) > 300
    rows = [*ODD, *[(100 + i, t) for i, t in enumerate(TRICKY)]]
    rows += [(300 + k, f"before key{k:03d}-{'xyz'[k % 3]}{k}=abc and KEY{k:03d}{'xyz'[k % 3]}{k}=ab token=abcdef{k}") for k in range(0, 200, 7)] * 2
    kinds = [*SECRETS, *[(n, p, lambda m: len(m[1]) >= 3) for n, p in more]]
    found = secret_scan.find_secrets(docs(rows), rules)
    assert Counter((r["doc_id"], *[(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in found.collect()) == expected(kinds, rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Python" not in plan and "Arrow" not in plan and ("BroadcastHashJoin" in plan) == broadcast


def test_one_index_serves_other_rules(spark, docs, monkeypatch):
    monkeypatch.setattr(secret_scan, "PIECE", 7)
    rows = [(1, "nothing to see"), (2, "a zebra-token here"), (3, None), (4, "ZEBRA\u2019s " + "z" * 40 + " quagga77"), (4, "QUAGGA7")]
    with secret_scan.Scratch(spark) as keep:
        index = secret_scan.build_index(docs(rows), keep)
        keys = {r["key"]: (r["doc_id"], r["_text"]) for r in docs(rows).select("doc_id", secret_scan.text_or_empty("text").alias("_text")).withColumn("key", secret_scan._key("doc_id")).collect()}
        for pattern, hits in (("zebra", {2, 4}), ("quagga\\d+", {4}), ("zebra.token", {2}), ("okapi", set())):
            got = secret_scan.candidates(index, (secret_scan.Rule("r", pattern),)).collect()
            assert {keys[r["key"]][0] for r in got} == hits and len(got) == len(set(r["key"] for r in got))
        scan = index.postings.where(secret_scan._equals_one("trigram", [f"a{k:02d}" for k in range(40)]))
        assert "PushedFilters: [Or(" in scan._jdf.queryExecution().executedPlan().toString().replace("\n", "")
