import fnmatch
import random
import re

import duckdb
import numpy as np

from weftmine.llm import urlfilter
from weftmine.llm.oracles import OP10

PAGES = "page_id long, url string, html string"
URLS = [
    "http://a.example.com/en/1", "https://WWW.Example.com/en/x?y#z", "http://www.example.com/EN/1", "https://m.x.net/es/1", "http://net/fr/", "http://internet/fr/", "https://x.net/fr",
    "http://a.com", "http://a.com?x=/en/", "http://a.com:80/x", "ftp://u@b.com/#/es/", "x://y://z.com/en/", "no scheme.com/en/", "", None, "http://", "http:///es/a", "https://cheap-x.example.org/a",
    "https://www.cheap-x.example.org", "https://uncheap-x.example.org/a", "https://x.org/ads/1", "https://x.org/a/b/ads/1", "https://x.org/ads", "https://x.org/get.exe?x", "https://ads.x.org/1", "http://é.ÀB.com/é/\n/ads/",
    "http://x.org/" + "a/" * 3000 + "ads/z", "http://spam-a.net/es/1", "http://example.com.org/en/",
]


def test_verdicts_are_those_of_sql(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], PAGES)
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = sorted(con.sql(OP10).fetchall())
    assert sorted(map(tuple, urlfilter.judge(pages).collect())) == want
    assert {(r[3], r[4]) for r in want} >= {("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"), (None, "block"), (None, "allow")}


def test_many_patterns_over_many_words_of_bits():
    r = random.Random(3)
    part = lambda n: "".join(r.choice("ab.*?") for _ in range(r.randint(1, n)))
    globs = [urlfilter.Glob(part(6) + ("/" + part(5) if r.random() < 0.6 else ""), "block") for _ in range(60)]
    automaton = urlfilter.Automaton([], globs)
    assert automaton.words > 4
    urls = [("".join(r.choice("ab.") for _ in range(r.randint(0, 7))), "".join(["/", *(r.choice("ab./") for _ in range(r.randint(0, 6)))]) if r.random() < 0.8 else "") for _ in range(400)]
    texts = [b"\xfe." + h.encode() + b"\xff" + p.encode() for h, p in urls]
    lengths = np.array([*map(len, texts)])
    got = automaton.run(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths)
    for k, g in enumerate(globs):
        host, slash, path = g.glob.partition("/")
        takes = [re.compile(fnmatch.translate(x), re.S) for x in (host, slash + path if slash else "*")]
        for i, (h, p) in enumerate(urls):
            assert got[i, k] == bool(takes[0].match("." + h) and takes[1].match(p)), (g, h, p)


def test_long_texts_go_alone(monkeypatch):
    import time

    r = random.Random(5)
    texts = [b"\xfe." + bytes(r.choice(b"ab./") for _ in range(n)) + b"\xff/" + bytes(r.choice(b"ab./") for _ in range(n)) for n in [*range(40)] * 3]
    lengths = np.array([*map(len, texts)])
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths
    automaton = urlfilter.Automaton([urlfilter.HostRule("b.a", "/a", "block"), urlfilter.HostRule("b", "/", "allow")], [urlfilter.Glob("*a?b*/*b", "block"), urlfilter.Glob("*/*a.b*", "allow"), *urlfilter.GLOBS])
    abreast = automaton.run(data, starts, lengths)
    monkeypatch.setattr(urlfilter, "LONG", 0)
    assert (automaton.run(data, starts, lengths) == abreast).all() and abreast.any(0).sum() >= 3
    monkeypatch.undo()
    long = b"\xfe.a.com\xff/" + b"a/" * 500_000 + b"x.zip"
    began = time.perf_counter()
    urlfilter.Automaton(urlfilter.HOST_RULES, urlfilter.GLOBS).run(np.frombuffer(long, np.uint8), np.zeros(1, int), np.array([len(long)]))
    assert time.perf_counter() - began < 5


def test_rows_without_an_id_or_url(spark):
    pages = spark.createDataFrame([(None, "http://a.com/x", None), (None, None, None), (1, "http://a.net/es/", "x")], PAGES)
    assert sorted(map(tuple, urlfilter.judge(pages).collect()), key=str) == sorted([(None, "a.com", "/x", "com/", "allow"), (None, "", "", None, "allow"), (1, "a.net", "/es/", "net/es/", "block")], key=str)


def test_the_longest_rule_holds_and_other_columns_do_not(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/x/y", None, "r", "v", "h")], PAGES + ", rule string, verdict string, host string")
    rules = [urlfilter.HostRule("c", "/x/", "block"), urlfilter.HostRule("b.c", "/x", "allow"), urlfilter.HostRule("a.b.c", "/z", "block")]
    assert [(r.rule, r.verdict) for r in urlfilter.judge(pages, rules, [urlfilter.Glob("*", "block")]).collect()] == [("b.c/x", "allow")]


def test_empty_table(spark):
    assert urlfilter.judge(spark.createDataFrame([], PAGES)).collect() == []
