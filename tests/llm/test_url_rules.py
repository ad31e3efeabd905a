import re

from larkspur.llm import url_rules as U

RULES = [U.prefix_rule("allow", "org", "/"), U.prefix_rule("block", "example.org", "/en/1"), U.prefix_rule("block", "a-b.com", "/x/y"), U.prefix_rule("allow", "com", "/")]
URLS = [
    "http://example.org/en/148", "https://www.Example.ORG/en/1", "http://example.org/en/2?x#y", "http://notexample.org/en/1", "http://org/", "http://org", "http://a.com/EN/1",
    "http://a-b.com/x/yz", "http://q.a-b.com/x/y", "http://x.net/casino", "http://my-casino.net/", "http://free-bets.example.net:80/a", "ftp://ADS.site.net", None, "", "no url", "http://", "://x.org/a",
    "http://é.org/ü?q", "http://a.org/p\nq", "http://ads.org/", "http://badspam.net/",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0].translate({c: c + 32 for c in range(65, 91)})
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [r for r in (("allow", "org", "/"), ("block", "example.org", "/en/1"), ("block", "a-b.com", "/x/y"), ("allow", "com", "/")) if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if fits:
        v, h, p = max(fits, key=lambda r: len(r[1] + r[2]))
        return host, path, h + p, v
    own = re.search(r"^(?:[^/?#]*[.-])?(casino|free[.-]bets|cheap[.-]pills|adult|spam|ads)([.:/-]|$)", host + path)
    return host, path, None, "block" if own else "allow"


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    for r in U.judge(df, RULES).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"]), r


def test_index_uses_the_rarest_token():
    index = U.index_of(RULES)
    assert 1 in index["en"] or 1 in index["example"]
    assert 2 in index["a"] or 2 in index["b"] or 2 in index["x"]
    assert sorted(i for ids in index.values() for i in ids) == [0, 1, 2, 3]


def test_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(empty, RULES).collect() == []
    df = spark.createDataFrame([(1, "http://casino.org/")], "page_id long, url string")
    assert U.judge(df, [], []).first()["verdict"] == "allow" and U.judge(df, [], default="block", default_rules=[]).first()["verdict"] == "block"
    assert U.judge(df, []).first()["verdict"] == "block"
    plan = U.judge(df, RULES)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_a_table_of_rules_gives_the_same_rows(spark, monkeypatch):
    rows = [(i, u, "clash") for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    want = sorted(map(str, U.judge(df, RULES).collect()))
    monkeypatch.setattr(U, "INLINE", 0)
    looked_up = U.judge(df, RULES)
    assert sorted(map(str, looked_up.collect())) == want
    assert "Python" not in looked_up._jdf.queryExecution().toString()
    for r in looked_up.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"]), r
    assert U.judge(df.limit(0), RULES).collect() == []


def test_a_hundred_thousand_rules(spark):
    rules = [U.prefix_rule(("block", "allow")[i % 2], f"site{i}.example", f"/a{i % 7}/") for i in range(100_000)]
    rules += [U.Rule("any number", "block", "[0-9]{9}", (), 1)]  # a rule without a literal token runs on every URL
    urls = [f"http://{'www.' * (i % 3)}site{i * 37 % 120_000}.example/a{i % 7}/x" for i in range(3000)] + ["http://hot.example/"] * 3000 + ["http://n.example/123456789", None, "no url"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    known = {r.name: r for r in rules}

    def plain(u):
        m = re.match(r"http://(?:www\.)*(site[0-9]+\.example)(/a[0-9]/)", u or "")
        r = known.get(m[1] + m[2]) if m else None
        if u and "123456789" in u:
            return "any number", "block"
        return (r.name, r.verdict) if r else (None, "allow")

    got = U.judge(df, rules).collect()
    assert len(got) == len(urls) and {r["verdict"] for r in got if r["rule"]} == {"allow", "block"}
    for r in got:
        assert (r["rule"], r["verdict"]) == plain(r["url"]), r


def test_rules_are_filed_under_their_rarest_token(spark):
    table = spark.createDataFrame([(r.name, r.verdict, r.pattern, list(r.tokens), r.weight) for r in RULES], U._RULE)
    index = U.index_of(RULES)
    assert {(r["name"], r["token"]) for r in U.filed(table).collect()} == {(RULES[i].name, t) for t, ids in index.items() for i in ids}
