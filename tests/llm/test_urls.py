import random
import re

from quillframe.llm import urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
SCHEMA = "page_id long, url string, html string, host string, rule string, url_filter string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(url):
    host, path = parts(url)
    fits = [(len(h + p), v == "allow", h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits) if fits else None


def key(url):
    host, _ = parts(url)
    rest = url.split("://", 1)[1]
    return host + rest[len(host) :].split("#")[0]


def brute(rows, links):
    edges, known = {}, {}
    for a, b in links:
        known.setdefault(key(a), set()).add(a)
        known.setdefault(key(b), set()).add(b)
        edges.setdefault(key(a), set()).add(key(b))
        edges.setdefault(key(b), set()).add(key(a))
    out = []
    for page_id, url, _ in rows:
        host, path = parts(url)
        rule = rule_of(url)
        verdict = "allow"
        if rule:
            verdict = rule[3]
        elif url and "://" in url:
            seen, todo = {key(url)}, [key(url)]
            while todo:
                for x in edges.get(todo.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            if any((r := rule_of(u)) and r[3] == "block" for k in seen for u in known.get(k, ())):
                verdict = "block"
        out.append((page_id, host, path, rule and rule[2], verdict))
    return sorted(out, key=str)


def result(spark, rows, links=None):
    df = spark.createDataFrame([(*r, "h", "r", "f") for r in rows], SCHEMA)
    extra = spark.createDataFrame(links, "src string, dst string") if links else None
    got = urls.judge(df, RULES, extra)
    assert got.columns == df.columns
    return sorted(((r.page_id, *r.url_filter) for r in got.collect()), key=str)


def test_rules_and_parsing(spark):
    us = ["http://example.com/en/1", "https://WWW.Example.COM/en/2?x#y", "http://a.b.example.com/en", "http://x.net/es/", "x.net/es/", None, "", "://net/fr/a", "http://net?/es/", "ftp://u@x.net:80/es/", "http://notexample.com/en/", "http://com", "http://a.com/q", "http://É.net/es/#f", "a://b://x.net/es/", "http://" + "a." * 5000 + "net/es/1", "http://x.org/" + "p/" * 20000]
    rows = [(i, u, None) for i, u in enumerate(us)] + [(None, us[0], ""), (0, us[0], None)]
    assert result(spark, rows) == brute(rows, [])
    assert result(spark, []) == []


def test_blocks_spread_over_links(spark):
    rng = random.Random(1)
    names = [f"http://h{i}.org/{i}" for i in range(60)] + [f"http://h{i}.net/es/{i}" for i in range(4)] + ["http://www.example.com/en/1", "http://example.com/en/9"]
    links = [(rng.choice(names), rng.choice(names)) for _ in range(45)]
    links += [("http://h1.org/1#top", "https://H2.org/2"), ("http://gone.org/", "http://h5.net/es/5"), ("http://gone.org/", "http://h3.org/3")]
    rows = [(i, u, None) for i, u in enumerate(names)]
    want = brute(rows, links)
    assert result(spark, rows, links) == want
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"}


def test_links_of_pages(spark):
    pages = [
        (1, "http://a.org/x", '<head><LINK href="http://s.net/es/1?a=1&amp;b=2" rel="canonical">'),
        (2, "http://b.org/d/x?q", "<meta http-equiv='Refresh' content='0; URL=/to'>"),
        (3, "http://c.org/d/x", "<link rel=canonical href=y.html>"),
        (4, "http://d.org/d", '<link rel="stylesheet" href="/s.css"><p>canonical</p>'),
        (5, "http://e.org", '<link rel="canonical" href="//f.net/fr/">'),
        (6, "no scheme", '<link rel="canonical" href="http://s.net/es/">'),
        (7, "http://g.org/", '<link rel="canonical" href="mailto:x">'),
        (8, None, '<link rel="canonical" href="http://s.net/es/">'),
        (9, "http://e.org/z", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r.src, r.dst) for r in urls.page_links(df).collect()}
    assert got == {
        ("http://a.org/x", "http://s.net/es/1?a=1&b=2"),
        ("http://b.org/d/x?q", "http://b.org/to"),
        ("http://c.org/d/x", "http://c.org/d/y.html"),
        ("http://e.org", "http://f.net/fr/"),
    }
    verdicts = {r[0]: r[4] for r in result(spark, pages)}
    assert [k for k, v in verdicts.items() if v == "block"] == [1, 5]


def test_every_link_of_a_page_counts(spark):
    refresh = '<meta http-equiv="refresh" content="0; url=%s">'
    pages = [
        (1, "http://a.org/x", '<link rel="canonical" href="/x">' + refresh % "http://s.net/es/1"),
        (2, "http://b.org/x", '<link rel="canonical" href="mailto:x">' + refresh % "http://s.net/es/2"),
        (3, "http://c.org/x", '<link rel="canonical" href="/y"><link rel="canonical" href="http://s.net/fr/">'),
        (4, "http://c.org/y", "<p>linked by a page that also links to a blocked one"),
        (5, "http://d.org/x", refresh % "/y" + refresh % "/z"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r.src, r.dst) for r in urls.page_links(df).collect()}
    assert got == {
        ("http://a.org/x", "http://a.org/x"),
        ("http://a.org/x", "http://s.net/es/1"),
        ("http://b.org/x", "http://s.net/es/2"),
        ("http://c.org/x", "http://c.org/y"),
        ("http://c.org/x", "http://s.net/fr/"),
        ("http://d.org/x", "http://d.org/y"),
        ("http://d.org/x", "http://d.org/z"),
    }
    verdicts = {r[0]: r[4] for r in result(spark, pages)}
    assert [k for k, v in verdicts.items() if v == "block"] == [1, 2, 3, 4]


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "http://a.org", "")], "page_id long, url string, html string")
    plan = urls.report(df, RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
