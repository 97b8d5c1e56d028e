from tablewright.llm import urlfilter as U

SCHEMA = "page_id long, url string, host string, rule int"


def plain(url):
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return host, path[:stop]


def plain_rule(host, path):
    best = None
    for text, verdict in U.RULES:
        h, p = text.partition("/")[0], text[text.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(text) > len(best[0])):
            best = text, verdict
    return best


URLS = [
    "https://www.example.net/en/1", "http://example.net/de/1", "http://EXAMPLE.NET/en/", "http://a.net", "http://a.net/", "http://a.net?x=/en/", "http://net/x", "http://xnet/x",
    "http://example.com/de/1#top", "http://sub.Example.com/de", "http://a.org/fr/?q", "http://org/fr/x", "http://a.org/FR/x", "no scheme", None, "", "://", "http://", "http://a.net:80/x",
    "http://Éxample.NET/x", "ftp://a.net/b://c.org/fr/", "http://a.com/x\ny/z", "http://best-casino.example/win", "http://docs.example/guide", "http://x.com/" + "a" * 30_000,
]


def test_hosts_paths_and_rules_equal_plain_python(spark):
    rows = [(k, u, "clash", 3) for k, u in enumerate(URLS)] + [(0, URLS[0], None, None)]
    got = U.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = plain(r.url)
        assert (r.host, r.path) == (host, path)
        fit = plain_rule(host, path)
        assert r.rule == (fit[0] if fit else None)
        assert r.verdict == (fit[1] if fit else ("block" if r.probability >= 0.5 else "allow"))
        assert 0 <= r.probability <= 1
    assert U.judged(spark.createDataFrame([], SCHEMA)).collect() == []


def test_classifier_tells_held_out_urls_apart():
    taught = [(*plain(u), v) for u, v in U.labelled_urls()]
    assert len(taught) > 300
    model = U.fit(taught)
    assert all((model.blocked(h, p) >= 0.5) == (v == "block") for h, p, v in taught)
    for url, block in (("http://my-casino-slots.example/jackpot", True), ("http://discount-viagra.example/pills", True), ("http://library.example/history/guide", False), ("http://en.example/wiki/garden", False)):
        assert (model.blocked(*plain(url)) >= 0.5) == block


def test_training_table_is_bounded(spark):
    df = spark.createDataFrame([("http://a.b/c", "block"), ("http://d.e/f", "allow")], "url string, verdict string")
    assert 0 <= U.train(df).blocked("a.b", "/c") <= 1
    # Beyond the bound a part of the table teaches, the same each time.
    many = spark.createDataFrame([(f"http://site{k}.b/c{k}", "block" if k % 2 else "allow") for k in range(300)] + [("http://site1.b/c1", "block"), (None, "allow"), ("x", None)], "url string, verdict string")
    few = [U.train(d, most_urls=20) for d in (many, many.repartition(5))]
    assert few[0].weights.any() and abs(few[0].weights - few[1].weights).max() < 1e-9
    assert U.fit([]).blocked("x", "/") == 0.5


def test_labelled_urls_tell_the_rest_of_them_apart():
    rows = [(*plain(u), v) for u, v in U.labelled_urls()]
    model = U.fit([r for k, r in enumerate(rows) if k % 4])
    held = [(model.blocked(h, p) >= 0.5) == (v == "block") for h, p, v in rows[::4]]
    assert sum(held) / len(held) > 0.9
