from zscape.llm import url_filter as U

PAGES = "page_id long, url string, html string, verdict string, node string"


def link(href):
    return f'<html><head><link rel="canonical" href="{href}"></head></html>'


def pages(spark, rows):
    return spark.createDataFrame([(*r, "v", "n") for r in rows], PAGES)


def test_rules(spark):
    rows = [
        (1, "http://A.example.com/en/7198#top", None), (2, "https://x.com/en/1", ""), (3, "http://b.example.net/de/81?x=1", "x"), (4, "http://foo.net/de/8", "x"),
        (5, "http://org/es/", None), (6, "http://notorg/es/", None), (7, None, None), (8, "no scheme/en/", None), (9, "http://x.com", None), (10, "HTTP://X.COM/en/", None), (10, "HTTP://X.COM/en/", None),
    ]
    out = {r["page_id"]: tuple(r)[1:5] for r in U.judge(pages(spark, rows)).collect()}
    assert out[1] == ("a.example.com", "/en/7198", "example.com/en/7", "allow") and out[2][2:] == ("com/en/", "block")
    assert out[3] == ("b.example.net", "/de/81", "example.net/de/8", "block") and out[4][2:] == ("net/de/", "allow")
    assert out[5][2:] == ("org/es/", "block") and out[6][2:] == (None, "allow")
    assert out[7] == out[8] == ("", "", None, "allow") and out[9] == ("x.com", "", None, "allow") and out[10][0] == "x.com"
    assert U.judge(pages(spark, rows)).count() == 11 and U.judge(pages(spark, []).where("false")).count() == 0


def test_decisions_reach_aliases(spark):
    rows = [
        (1, "http://a.io/1", link("http://bad.com/en/1")),  # blocked target that is no page
        (2, "http://a.io/2", link("http://a.io/1#x")),  # through another alias
        (3, "http://b.io/1", '<meta http-equiv="refresh" content="0; url=http://bad.com/en/2">'),
        (4, "http://bad.com/en/2", link("http://www.example.com/en/7x")),  # own rule stands
        (5, "http://b.io/2", link("/1")),  # relative, to 3
        (6, "http://c.io/1", link("other")),
    ]
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge(pages(spark, rows)).collect()}
    assert out[1] == out[2] == (None, "block")
    assert out[3] == out[5] == (None, "allow")  # allow comes first in the component
    assert out[4] == ("com/en/", "block") and out[6] == (None, "allow")


def test_all_forms_of_redirects(spark):
    meta = lambda attributes: f"<html><meta charset=utf-8><meta {attributes}></html>"
    forms = [
        'content="0;url=U" http-equiv="refresh"', """http-equiv="refresh" content="0;url='U'\"""", 'http-equiv=refresh content="0,url=U"', "HTTP-EQUIV='Refresh' CONTENT='5 ; URL = U'",
        "content='0; url=\"U\"' name=x http-equiv=refresh", 'http-equiv = "refresh"\n content = "0 url=U"', "content=0;url=U http-equiv=refresh", 'http-equiv="refresh" content="0; url=U"',
    ]
    rows = [(i, f"http://a{i}.io/1", meta(f.replace("U", f"http://bad{i}.com/en/1") if "URL" not in f else f.replace(" U'", f" http://bad{i}.com/en/1'"))) for i, f in enumerate(forms)]
    two = '<meta http-equiv="refresh" content="9;url=http://c.io/x"><meta http-equiv="refresh" content="0;url=http://bad.com/en/2">'
    rows += [(50, "http://c.io/1", two), (51, "http://c.io/2", link("http://c.io/y") + link("http://bad.com/en/3"))]
    quiet = ['http-equiv="refresh" content="30"', 'name="description" content="0;url=http://bad.com/en/4"', 'http-equiv="refresh" data-content="0;url=http://bad.com/en/4"']
    rows += [(60 + i, f"http://d{i}.io/1", meta(q)) for i, q in enumerate(quiet)]
    out = {r["page_id"]: r["verdict"] for r in U.judge(pages(spark, rows)).collect()}
    assert out == {i: "allow" if i >= 60 else "block" for i in out}, out


def test_sql_agrees(spark, tmp_path):
    import duckdb

    rows = [(i, f"http://h{i % 7}.com/{'en' if i % 3 else 'fr'}/{i}", link(f"http://h{i % 5}.net/de/8{i % 4}") if i % 2 else "") for i in range(60)]
    frame = pages(spark, rows)
    frame.select("page_id", "url", "html").write.parquet(str(tmp_path / "p"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/p/*.parquet'")
    want = sorted(map(str, con.execute(U.ORACLE_SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in U.judge(frame).collect()) == want


def test_links_of_real_pages(spark):
    bad = "http://bad.com/en/1"
    block = [
        f'<link rel = "canonical" href = "{bad}">', f"<LINK HREF={bad} REL=Canonical>", f'<link rel="nofollow canonical" title="a > b" href="{bad}"/>', f'<link title="href=x" rel="canonical"href=\'{bad}\'>',
        f'<meta content="0; url=\'{bad}\'" http-equiv=refresh>', f"<meta http-equiv='refresh' content='0; {bad}'>", '<link rel=canonical href="//bad.com/en/1">',
        '<link rel=canonical href="http://bad.com/x/../en/./1">', '<link rel=canonical href="http://bad.com/&#101;n&#x2F;1">', f"<!-- > --><link rel=canonical href={bad}><!-- <link rel=canonical href=http://z.io/> -->",
        f'<base href="http://bad.com/fr/"><link rel=canonical href="../en/1">', f'<link rel=canonical href="/x"><link rel=canonical href="{bad}">', f'<link rel=canonical href=" http://bad.com/\n en/1">'.replace("\n ", "\n"),
    ]
    allow = [
        f"<!-- <link rel=canonical href={bad}> -->", f"<script>'<link rel=canonical href={bad}>'</script>", f"<!-- <link rel=canonical href={bad}>", f'<a rel=canonical href="{bad}">', f'<link rel=alternate href="{bad}">',
        f'<link rel=canonical data-href="{bad}">', '<link rel=canonical href="mailto:a@bad.com/en/">', '<link rel=canonical href="#x">', '<meta http-equiv=refresh content=5>',
    ]
    rows = [(i, f"http://a{i}.io/p/1", h) for i, h in enumerate(block)] + [(100 + i, f"http://b{i}.io/p/1", h) for i, h in enumerate(allow)]
    out = {r["page_id"]: r["verdict"] for r in U.judge(pages(spark, rows)).collect()}
    assert out == {i: "allow" if i >= 100 else "block" for i in out}, out


def test_resolution(spark):
    # the examples of RFC 3986, 5.4
    base = "http://a/b/c/d;p?q"
    want = {
        "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q", "g#s": "http://a/b/c/g",
        ".": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./g/.": "http://a/b/c/g/", "g/../h": "http://a/b/c/h", "HTTP://A/x": "http://a/x",
    }
    got = spark.createDataFrame([(t, base) for t in want], "t string, u string")
    assert {r[0]: r[1] for r in got.select("t", U.node(U.resolved(got["t"], got["u"]))).collect()} == want


def test_very_long_html_and_hot_urls(spark, monkeypatch):
    from functools import partial

    monkeypatch.setattr(U, "evenly_joined", partial(U.evenly_joined, together=5))
    long = "<meta " + "a=b " * 200_000 + ">" + "<script" * 20_000 + "</script>" + link("http://bad.com/en/1")
    rows = [(0, "http://a.io/1", long)] + [(i, "http://b.io/1" if i % 2 else None, link("http://a.io/1")) for i in range(1, 60)]
    out = {r["page_id"]: r["verdict"] for r in U.judge(pages(spark, rows)).collect()}
    assert out == {i: "allow" if i and not i % 2 else "block" for i in range(60)}
