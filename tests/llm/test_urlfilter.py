from corroborate.llm import urlfilter as U

PAGE = "page_id long, url string, html string"


def judged(spark, rows, edges=None, schema=PAGE):
    e = spark.createDataFrame(edges, "source string, target string") if edges else None
    return {r.page_id: r for r in U.judge(spark, spark.createDataFrame(rows, schema), e).collect()}


def test_rules_hosts_and_paths(spark):
    urls = ["https://a.net/x", "http://Example.NET/en/1", "https://m.example.net/fr/", "https://example.com/de/?q", "https://example.com/de", "http://x.org/fr/y#f", "https://notnet/", "net://net", "no scheme net/", None, "https://evil.com/?u=://a.net/", "https://host.net", "x://y.net?a/b"]
    got = judged(spark, [(k, u, None) for k, u in enumerate(urls)])
    assert [(got[k].rule, got[k].verdict) for k in range(len(urls))] == [
        ("net/", "block"), ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), (None, "allow"), ("org/fr/", "allow"), (None, "allow"),
        (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"),
    ]
    assert (got[1].host, got[1].path) == ("example.net", "/en/1") and (got[9].host, got[9].path) == ("", "") and (got[11].host, got[11].path) == ("host.net", "")


def test_aliases_take_over_decisions_and_allow_goes_first(spark):
    link = '<link href="{}" REL="canonical">'
    rows = [
        (1, "https://one.com/", link.format("https://bad.net/p")),
        (2, "https://two.com/", '<meta http-equiv="refresh" content="0; url=https://one.com/">'),
        (3, "https://three.com/", link.format("https://bad.net/q") + '<meta http-equiv=refresh content="1;url=https://a.org/fr/1">'),
        (4, "https://alone.com/", link.format("https://alone.com/")),
        (5, "https://bad.net/p", None),
        (6, "https://hop1.com/", None),
        (1, "https://one.com/", None),
    ]
    edges = [("https://hop1.com/", "https://hop2.com/"), ("https://hop2.com/", "https://two.com/"), (None, "https://x.com/")]
    got = judged(spark, rows, edges)
    assert {k: (r.verdict, r.by) for k, r in got.items()} == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("allow", "alias"), 4: ("allow", "default"), 5: ("block", "rule"), 6: ("block", "alias")}


def test_links_of_all_kinds_are_found_and_resolved(spark):
    rows = [
        ("https://A.com/x/y.html?q#f", '<link rel="canonical" href="/c">', "https://a.com/c"),
        ("https://a.com/x/y", '<link href="//bad.net/p" rel=canonical>', "https://bad.net/p"),
        ("https://a.com/x/y", '<link rel="nofollow CANONICAL" href="z/../w?a=1&amp;b=2">', "https://a.com/x/w?a=1&b=2"),
        ("https://a.com/x/y", "<link rel='canonical' href='?k=1'>", "https://a.com/x/y?k=1"),
        ("https://a.com", "<link rel=canonical href=b>", "https://a.com/b"),
        ("https://a.com/x", '<META content="5; URL=\'/new\'" http-equiv="Refresh">', "https://a.com/new"),
        ("https://a.com/x", '<meta http-equiv=refresh content="0;url=HTTP://B.com:80/./p/..//q#z">', "http://b.com//q"),
        ("https://a.com/x", '<link rel="canonical" href="&#104;ttps://b&#x2e;com/&#x20ac;&eacute;&amp;lt;">', "https://b.com/€&eacute;&lt;"),
        ("https://a.com/x", '<base href="https://c.com/d/"><link rel="canonical" href="e">', "https://c.com/d/e"),
        ("https://a.com/x", '<!-- <link rel="canonical" href="https://bad.net/"> -->', None),
        ("https://a.com/x", '<link rel="canonical" href="mailto:a@b.net"><link rel="canonical" href=""><meta http-equiv="refresh" content="30">', None),
        ("https://a.com/x", '<link rel="canonical" href="#top"><link rel="stylesheet" data-href="/canonical" href="/s.css">', None),
        ("https://a.com/x", '<link data-rel="canonical" href="/s"><!-- canonical', None),
        ("https://a.com/x", None, None),
        (None, '<link rel="canonical" href="/c">', None),
    ]
    table = spark.createDataFrame([(k, url, html) for k, (url, html, _) in enumerate(rows)], "k long, url string, html string")
    got = {k: [r.target for r in U.edges_of(table.filter(f"k = {k}")).collect()] for k in range(len(rows))}
    assert got == {k: [want] if want else [] for k, (_, _, want) in enumerate(rows)}
    several = '<link rel="canonical" href="/1"><link rel="canonical" href="/2"><meta http-equiv="refresh" content="0; url=/3"><meta http-equiv="refresh" content="0; url=/4">'
    assert U.edges_of(spark.createDataFrame([("https://a.com/", several)], "url string, html string")).count() == 4


def found(spark, rows):
    """{k: sorted targets} of rows (k, url, html)."""
    edges = U.edges_of(spark.createDataFrame([(u, h) for _, u, h in rows], "url string, html string")).collect()
    return {k: sorted(e.target for e in edges if e.source == u) for k, u, _ in rows}


def test_tags_attributes_and_hidden_text(spark):
    bad = '<link rel=canonical href=https://bad.net/p>'
    cases = [
        ('<link rel="canonical" title="see href=https://bad.net/p" href="https://ok.org/q">', ["https://ok.org/q"]),
        ('<link rel="canonical" data-x="1>0" href="https://bad.net/p">', ["https://bad.net/p"]),
        (f'<script>var s="{bad}"</script>', []),
        (f"<SCRIPT type='a>b'>{bad}</script ><style>{bad}</style><textarea>{bad}</textarea><title>{bad}</title><template>{bad}</template>", []),
        (f"<script>// <!-- </script>{bad}<!-- <script> -->{bad.replace('/p', '/r')}", ["https://bad.net/p", "https://bad.net/r"]),
        (f"<div data-x='{bad}'>", []),
        (f'<a title="x" y=">{bad}', []),
        (f"<!-->{bad}<!--->{bad.replace('/p', '/r')}", ["https://bad.net/p", "https://bad.net/r"]),
        (f"<p title=it's>{bad}<p title='>", ["https://bad.net/p"]),
        (f"<scripted>{bad}</scripted><linker rel=canonical href=/no>", ["https://bad.net/p"]),
        ("<link rel = canonical HREF = 'https://a.org/x?y=\"1\"' href=/second/>", ['https://a.org/x?y="1"']),
        ("<link/rel=canonical/href=/s/>", []),
        ("<link rel=canonical href=/a%7Eb/%2e%2E/c%3ad%zz?%41=%2f>", ["https://page10.com/c%3Ad%zz?A=%2F"]),
        ("<base data-href='/no' href='https://b.org/d/'><link rel=canonical href=e>", ["https://b.org/d/e"]),
        (f"<script>{bad}", []),
        (bad + "<i>text</i>" * 60_000 + bad.replace("/p", "/r") + "<p title=" + '"x" a=' * 30_000 + ">", ["https://bad.net/p", "https://bad.net/r"]),
    ]
    rows = [(k, f"https://page{k}.com/", html.replace("page10", f"page{k}")) for k, (html, _) in enumerate(cases)]
    assert found(spark, rows) == {k: [w.replace("page10", f"page{k}") for w in want] for k, (_, want) in enumerate(cases)}


def test_escaped_and_plain_urls_are_one_node(spark):
    rows = [(1, "https://one.com/%7Ex", '<link rel="canonical" href="https://bad.net/p">'), (2, "https://one.com/~x", None), (3, "https://one.com/%7ex#f", None), (4, "https://one.com/%2Fx", None), (5, "https://one.com/%2fx", None), (6, "https://one.com//x", None)]
    got = judged(spark, rows)
    assert {k for k, r in got.items() if r.verdict == "block"} == {1, 2, 3}


def test_links_are_those_of_a_plain_parser(spark):
    """Pages put together at random from pieces on which html.parser and the standard agree."""
    import random
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.links, self.base = [], None

        def handle_starttag(self, tag, attrs):
            a = {}
            for n, v in attrs:
                a.setdefault(n, v or "")
            if tag == "base" and self.base is None:
                self.base = a.get("href", "")
            if tag == "link" and "canonical" in a.get("rel", "").lower().split() and a.get("href"):
                self.links.append(a["href"])
            if tag == "meta" and a.get("http-equiv", "").strip().lower() == "refresh" and "url=" in a.get("content", ""):
                self.links.append(a["content"].split("url=", 1)[1])

        handle_startendtag = handle_starttag

    rng = random.Random(8)
    n = iter(range(10**6))
    value = lambda: rng.choice(["/p{}", "q{}?a=b", "https://x{}.org/z", "//y{}.net/", "/a>b{}", "/{}?t=href", "/it&amp;s{}"]).format(next(n))

    def attribute(name, v):
        quote = rng.choice("\"'" + ("" if set(v) & set("> '\"=") else " "))
        return f"{rng.choice([name, name.upper()])}{rng.choice(['=', ' = '])}" + (f"{quote}{v}{quote}" if quote != " " else v)

    def link():
        more = [attribute(f"data-{k}", rng.choice(["1>0", "see href=/no", "rel=canonical", "<link rel=canonical href=/no>", "plain"])) for k in range(rng.randrange(3))]
        own = [attribute("rel", rng.choice(["canonical", "x CANONICAL", "stylesheet", "canonicals"])), attribute("href", value())]
        parts = own + more
        rng.shuffle(parts)
        return f"<{rng.choice(['link', 'LINK'])} {' '.join(parts)} {rng.choice(['', '/'])}>"

    def meta():
        parts = [attribute("http-equiv", rng.choice(["refresh", " Refresh ", "refreshed"])), attribute("content", f"{rng.randrange(9)}; url={value()}")]
        rng.shuffle(parts)
        return f"<meta {' '.join(parts)}>"

    def piece():
        kind = rng.randrange(8)
        return [link, meta, lambda: f"<!-- {link()} -->", lambda: f"<script>{link()}</script>", lambda: f"<style>{link()}</style>", lambda: f"<p {attribute('title', 'a > b')}>text & more</p>", lambda: f"<div {attribute('data-x', '<meta http-equiv=refresh content=0;url=/no>')}>", link][kind]()

    rows, want = [], {}
    for k in range(150):
        html = "".join(piece() for _ in range(rng.randrange(1, 9)))
        if rng.random() < 0.2:
            html = f'<base href="/base{k}/">' + html
        url = f"https://page{k}.com/dir/file"
        p = Plain()
        p.feed(html)
        p.close()
        base = urljoin(url, p.base) if p.base else url
        want[k] = sorted(urljoin(base, x) for x in p.links)
        rows.append((k, url, html))
    assert found(spark, rows) == want and sum(map(len, want.values())) > 100


def test_relative_and_encoded_links_pass_decisions_on(spark):
    rows = [
        (1, "https://one.com/a", '<link rel="canonical" href="/c">'),
        (2, "https://one.com/c", '<meta http-equiv="refresh" content="0; url=//bad.net/p?x=1&amp;y=2">'),
        (3, "HTTPS://BAD.net:443/p?x=1&y=2#part", None),  # no rule fits the host with its port, but its node is that of (2)'s target
        (4, "https://two.com/", '<!-- <link rel="canonical" href="https://bad.net/p"> -->'),
        (5, "https://ONE.com/./a#b", None),
        (6, None, None),
        (7, "https://three.com/", '<link rel="canonical" href="https://one.com/a"><link rel="canonical" href="https://x.org/fr/1">'),
    ]
    got = judged(spark, rows[:6])
    assert {k: (r.verdict, r.by) for k, r in got.items()} == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("block", "alias"), 4: ("allow", "default"), 5: ("block", "alias"), 6: ("allow", "default")}
    assert {k: (r.verdict, r.by) for k, r in judged(spark, rows).items()}[1] == ("allow", "alias")


def test_urls_of_many_pages_are_joined_apart(spark, monkeypatch):
    from corroborate import session

    monkeypatch.setattr(session, "HOT_PARTS", 8)
    rows = [(k, "https://hot.com/" if k % 3 == 0 else "https://cold.com/" if k % 3 == 1 else f"https://c{k}.com/", '<link rel="canonical" href="https://bad.net/x">' if k in (0, 2) else None) for k in range(90)]
    rows += [(k, None, None) for k in range(90, 120)]
    got = judged(spark, rows)
    assert {k for k, r in got.items() if r.verdict == "block"} == {k for k in range(90) if k % 3 == 0} | {2} and len(got) == 120


def test_empty_table_and_clashing_columns(spark):
    assert judged(spark, []) == {}
    rows = [(1, "https://a.net/", None, "c"), (1, "https://a.net/", None, "c"), (None, None, None, "c")]
    df = spark.createDataFrame(rows, PAGE + ", host string")
    assert U.judge(spark, df).count() == 3


def test_main_path_has_no_python(spark):
    plan = U.judge(spark, spark.createDataFrame([(1, "https://a.net/", None)], PAGE))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
