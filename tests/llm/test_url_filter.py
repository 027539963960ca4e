import random
import re

from spendkit.llm import url_filter


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (m[1].translate(low), m[2]) if m else ("", "")


def judge(url, rules, default):
    host, path = parts(url)
    fits = [
        (len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p or "")
    ]
    best = max(fits, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


def test_against_brute_force(spark, pages_of):
    rng = random.Random(2)
    labels = ["com", "net", "example", "a", "b", "www", "xn--ü"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))
    path = lambda: "".join(rng.choice(["/", "/en/", "/e", "x"]) for _ in range(rng.randrange(4)))
    urls = [f"{rng.choice(['http', 'HTTPS', 'x'])}://{host().upper()}{path()}{rng.choice(['', '?q=://z/', '#f'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "http://", "://com/", "http://com", "http://examplecom/", "http://.com/", "http://com./", "a\nb://com/\n/x"]
    urls += ["http://www.example.com/en/page"] * 300
    rules = list({(host(), path(), rng.choice(["allow", "block"])) for _ in range(60)}) + [("com", "/", "allow"), ("com", "/", "block"), ("", "/", "block")]
    rows = [(k if k % 50 else None, u, "") for k, u in enumerate(urls)]
    got = url_filter.filter_urls(pages_of(rows), spark.createDataFrame(rules + rules[:5], url_filter.RULE_SCHEMA), "allow")
    want = [(i, u, *judge(u, [r for r in rules if r[0]], "allow")) for i, u, _ in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_default_and_empty_tables(spark, pages_of):
    rules = spark.createDataFrame([("com", None, "allow")], url_filter.RULE_SCHEMA)
    got = url_filter.filter_urls(pages_of([(1, "http://a.com", ""), (2, "http://a.net/", "")]), rules, "block")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got.collect()} == {1: ("com", "allow"), 2: (None, "block")}
    assert url_filter.filter_urls(pages_of([]), rules).collect() == []
    none = spark.createDataFrame([], url_filter.RULE_SCHEMA)
    assert [r["verdict"] for r in url_filter.filter_urls(pages_of([(1, "http://a.com", "")]), none).collect()] == ["allow"]
