import random

from versetide.llm import url_rules as U


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h.split(".")), len(p), h + (p or "/"), v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def judge(spark, urls, rules, **more):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = U.judge_urls(pages, table, **more).collect()
    assert len(got) == len(urls)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}


def test_nested_rules_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(U, "SWEEP_ROWS", 9)  # many partitions, so that stacks are carried over
    rng = random.Random(6)
    labels = ["a", "b", "c", "ab", "net"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, n)))
    path = lambda n: "".join("/" + rng.choice(["x", "xy", "y", ""]) for _ in range(rng.randrange(n)))
    rules = {(host(4), path(3)): rng.choice(["block", "allow"]) for _ in range(60)}
    rules = [(v, h, p) for (h, p), v in rules.items()]
    urls = [f"http://{host(6)}{path(5)}{rng.choice(['', '?q=/x', '#f', '?a://b'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "http:///x", "HTTP://A.B/x", "x://net?x", "ftp://.a/", "http://a./x"]
    urls += ["http://www.a.net/x"] * 150
    got = judge(spark, urls, rules)
    for i, url in enumerate(urls):
        assert got[i] == brute(url, rules), url


def test_equal_rules_null_paths_and_default(spark):
    rules = [("block", "a.b", None), ("allow", "a.b", ""), ("block", None, "/"), ("block", "", "/x"), ("block", "A.C", "/")]
    got = judge(spark, ["http://a.b/q", "http://z.a.b", "http://a.c/", "http://b/x", None], rules, default="unknown")
    assert [got[i][2:] for i in range(5)] == [("a.b/", "allow"), ("a.b/", "allow"), ("a.c/", "block"), (None, "unknown"), (None, "unknown")]


def test_no_rules_and_no_pages(spark):
    assert judge(spark, ["http://a/"], [])[0] == ("a", "/", None, "allow")
    assert judge(spark, [], [("block", "a", "/")]) == {}
