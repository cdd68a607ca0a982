
from quarry.llm.urls import RULES, judge_urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), tail[:end]


def rule(host, path):
    fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def rank(seeds, links, damping=0.85):
    total = sum(seeds.values())
    base = {h: (1 - damping) * n / total for h, n in seeds.items()} if total else {}
    now = dict(base)
    for _ in range(60):
        new = dict(base)
        for src, dsts in links.items():
            for dst, w in dsts.items():
                new[dst] = new.get(dst, 0) + damping * now.get(src, 0) * w / sum(dsts.values())
        now = new
    return now


def brute(rows):
    trusted, blocked, out, back = {}, {}, {}, {}
    for _, url, html, targets in rows:
        host, path = split(url)
        verdict = rule(host, path)[1]
        if host and verdict:
            seeds = trusted if verdict == "allow" else blocked
            seeds[host] = seeds.get(host, 0) + 1
        for t in set(targets):
            if host and t != host:
                out.setdefault(host, {})[t] = out.get(host, {}).get(t, 0) + 1
                back.setdefault(t, {})[host] = back.get(t, {}).get(host, 0) + 1
    good, bad = rank(trusted, out), rank(blocked, back)
    result = []
    for i, url, _, _ in rows:
        host, path = split(url)
        name, verdict = rule(host, path)
        result.append((str(i), host, path, str(name), verdict or ("block" if bad.get(host, 0) > 0.5 * (bad.get(host, 0) + good.get(host, 0)) else "allow")))
    return sorted(result)


def case():
    page = lambda i, url, *targets: (i, url, "<p>x</p>" + "".join(f'<A HREF="{["http:", "https:", ""][k % 3]}//{t.upper()}/p?q">' for k, t in enumerate(targets)) + '<a href="/local">', list(targets))
    rows = [
        page(1, "http://a.org/x", "b.net", "c.net"), page(2, "http://b.net/y", "d.net"), page(3, "http://d.net/"), page(4, "http://spam.com/de/1", "c.net"),
        page(5, "http://farm.net/", "spam.com", "spam.com"), page(6, "http://ring.net/q?x", "farm.net"), page(7, "http://c.net/z", "spam.com", "b.net"),
        page(8, "https://WWW.Example.ORG/es/1#f"), page(9, "https://example.org/en/12"), page(10, "https://example.org/en/2"), page(11, "https://notexample.org/es/"),
        page(12, "http://x.com/fr/"), page(13, "http://org"), page(14, "http://a.org"), page(15, "http://com/de/x"), page(16, "http://xcom/de/x"),
        page(17, "no scheme/de/"), page(18, None, "spam.com"), page(19, ""), page(20, "http:///path"), page(21, "x://É.COM/fr/ü?://y"), page(22, "a://b://c/d"),
        page(23, "http://mixed.com/fr/1"), page(24, "http://mixed.com/de/1"), page(25, "http://mixed.com/de/2"), page(26, "http://mixed.com/en/2"), page(27, "http://alone.net/"),
    ]
    return [*rows, rows[3], (None, "http://ring.net/", None, [])]


def test_against_brute_force(spark):
    rows = case()
    pages = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h, _ in rows], "page_id long, url string, html string, host string, n int")
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in judge_urls(pages).collect())
    assert got == brute(rows)
    by = {r[0]: r[4] for r in got}
    assert by["5"] == by["6"] == "block" and by["3"] == by["27"] == "allow"


def test_empty(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_chain(spark):
    from quarry.llm.urls import propagate
    from quarry.storage import Scratch

    edges = spark.createDataFrame([("block", f"h{i}", f"h{i + 1}", 1.0) for i in range(22)], "kind string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("block", "h0", 1.0)], "kind string, host string, mass double")
    got = {r.host: r.score for r in propagate(edges, seeds, Scratch(spark, "chain"), damping=0.5, tolerance=0.1).collect()}
    assert got.keys() == {f"h{i}" for i in range(23)} and abs(got["h22"] - 0.5**23) < 1e-12


def test_number_of_seeds_decides_nothing(spark):
    from quarry.llm.urls import propagate
    from quarry.storage import Scratch

    edges = spark.createDataFrame([("block", f"h{i}", f"h{i + 1}", 1.0) for i in range(6)], "kind string, src string, dst string, weight double")
    few = spark.createDataFrame([("block", "h0", 1.0)], "kind string, host string, mass double")
    many = spark.range(200_000).selectExpr("'block' AS kind", "if(id = 0, 'h0', concat('s', id)) AS host", "1 / 200000.0D AS mass")
    a, b = ({r.host: r.score for r in propagate(edges, s, Scratch(spark, "seeds")).where("host like 'h%'").collect()} for s in (few, many))
    assert a.keys() == b.keys() == {f"h{i}" for i in range(7)}
    assert all(abs(a[h] - b[h] * 200_000) < 1e-6 for h in a)
