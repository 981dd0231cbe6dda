import random

import pytest

from fmlattice.llm.queries import URL_RULES
from fmlattice.llm.url_filter import ALLOW, BLOCK, UrlTrie, judge
from tests.llm.frames import frame  # noqa: F401

SCHEMA = "page_id long, url string, html string, host string, Path int, rule string, verdict int, host_size string"


def address(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    end = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[:min([path.index(c) for c in "?#" if c in path] + [len(path)])]


def brute(url, rules, default=ALLOW):
    host, path = address(url)
    fit = [r for r in rules if (not r[1] or host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if not fit:
        return host, path, None, default
    verdict, rhost, rpath = max(fit, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == ALLOW))
    return host, path, rhost + rpath, verdict


URLS = [None, "", "no scheme", "://", "http://", "http://org", "http://org/", "https://A.ORG/x?y#z", "http://example.org/es",
        "http://example.org/es/", "http://www.Example.org/en/17?p=1", "http://notexample.org/en/1", "http://example.org/en//1",
        "http://example.org/EN/1", "x://y://example.org/es/", "http://u:p@example.org:80/es/", "http://com/fr/", "http://a.b.com/de/1",
        "http://a.b.com/de", "http://.com/fr/x", "http://com./fr/x", "http://ÄÖ.com/fr/é", "http://example.org#/es/", "http://e.net/fr/",
        "http://com?x=/fr/", "a\nhttp://b.com/fr/\nx", "http://org\n/x", "http://" + "a." * 50_000 + "org/" + "x/" * 50_000]


def test_rules_of_the_query(frame):
    rows = [(i, u, None, "h", 1, "r", 2, "s") for i, u in enumerate(URLS)] + [(None, "http://b.org/", None, "h", 1, "r", 2, "s")] * 2
    got = sorted((r["page_id"] is None, r["page_id"], *r[1:]) for r in judge(frame(rows, SCHEMA), URL_RULES).collect())
    assert got == sorted((r[0] is None, r[0], *brute(r[1], URL_RULES)) for r in rows)
    assert judge(frame([], SCHEMA), URL_RULES).collect() == []


def test_random_rules_in_any_number_of_tries(frame):
    rnd = random.Random(3)
    labels, segments = ["a", "b", "ab", "", "c"], ["x", "y", "xy", "", "z"]

    def host():
        return ".".join(rnd.choice(labels) for _ in range(rnd.randint(0, 3)))

    def path():
        return rnd.choice(["", "/"]) + "/".join(rnd.choice(segments) for _ in range(rnd.randint(0, 3)))

    rules = sorted({(rnd.choice([ALLOW, BLOCK]), host(), path()) for _ in range(60)})
    urls = [f"s://{host()}{'/' + path() if rnd.random() < .8 else ''}{rnd.choice(['', '?q', '#f'])}" for _ in range(500)]
    pages = frame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(3)
    want = [(i, *brute(u, rules, BLOCK)) for i, u in enumerate(urls)]
    for size in (1000, 7, 1):
        some = rules if size > 1 else rules[:4]
        got = sorted(tuple(r) for r in judge(pages, some, BLOCK, trie_rules=size).collect())
        assert got == (want if size > 1 else [(i, *brute(u, some, BLOCK)) for i, u in enumerate(urls)])
    got = sorted(tuple(r) for r in judge(pages, rules, BLOCK, trie_chars=40).collect())
    assert got == want


def test_ties_and_no_rules(frame):
    assert UrlTrie([(BLOCK, "a", "/"), (ALLOW, "a", "/")]).longest("a", "/")[2] == ALLOW
    assert UrlTrie([(ALLOW, "a", "/xyz"), (BLOCK, "b.a", "/x")]).longest("b.a", "/xyz")[1] == "b.a/x"
    pages = frame([(1, "http://a/")], "page_id long, url string")
    assert [tuple(r) for r in judge(pages, []).collect()] == [(1, "a", "/", None, ALLOW)]
    with pytest.raises(ValueError):
        UrlTrie([("maybe", "a", "/")])
