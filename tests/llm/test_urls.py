from __future__ import annotations

from phaseflow.llm import urls
from phaseflow.llm.registry import RULES


def judged(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(df, RULES).collect()}


def test_hosts_paths_and_rules(spark):
    got = judged(spark, [
        (1, "HTTP://Blog.Example.ORG/es/x?q#f", None),
        (2, "http://example.org/en/12", ""),
        (3, "http://example.org", "<html>"),
        (4, "https://org/", None),
        (5, "ftp://notexample.org/es/", None),
        (6, "no scheme", None),
        (7, None, None),
        (8, "http://a.com/fr/", None),
        (9, "http://com/de/?x", None),
        (10, "http://ÄB.com#x", None),
        (11, "://", None),
        (12, "http://h?a=http://org/", None),
    ])
    assert got == {
        1: ("blog.example.org", "/es/x", "example.org/es/", "block"),
        2: ("example.org", "/en/12", "example.org/en/1", "block"),
        3: ("example.org", "", None, "allow"),
        4: ("org", "/", "org/", "allow"),
        5: ("notexample.org", "/es/", "org/", "allow"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("a.com", "/fr/", "com/fr/", "allow"),
        9: ("com", "/de/", "com/de/", "block"),
        10: ("Äb.com", "", None, "allow"),
        11: ("", "", None, "allow"),
        12: ("h", "", None, "allow"),
    }


def test_aliases(spark):
    link = '<LINK href="{}" rel="canonical">'.format
    turn = "<meta http-equiv=refresh content='0; url={}'>".format
    got = judged(spark, [
        (1, "http://x.net/a", link("http://y.com/de/1")),  # alias of a blocked page
        (2, "http://y.com/de/1", None),
        (3, "http://z.net/", turn("http://x.net/a#top")),  # through another one
        (4, "http://z.net/far", None),
        (5, "http://q.net/1", link("/2")),  # component with an allowed page
        (6, "http://q.net/2", turn("http://w.com/de/2")),
        (7, "http://w.com/de/2", link("http://w.com/fr/2")),
        (8, "http://w.com/fr/2", None),
        (9, "http://x.net/a", "nothing"),  # the same address again
        (10, "http://u.net/", link("relative") + link("mailto:x")),
        (11, "https://X.net/a", None),
    ])
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "block", 10: "allow", 11: "block"}


def test_extra_columns_and_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string, host string, rule int, node string")
    assert urls.judged(df, RULES).count() == 0


def test_one_component_of_many_pages(spark):
    """A chain of 10,000 pages behind one hot address, with a blocked page at its end."""
    link = '<link rel="canonical" href="{}">'.format
    rows = [(0, "http://y.com/de/0", None)]
    rows += [(k, f"http://p{k % 7}.net/{k}", link("http://hot.net/" if k % 2 else f"http://p{(k - 1) % 7}.net/{k - 1}" if k > 1 else "http://y.com/de/0")) for k in range(1, 10_001)]
    rows += [(20_000, "http://hot.net/", link("http://y.com/de/0")), (20_001, "http://hot.net/other", None), (20_002, "http://q.org/1", link("http://hot.net/"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    out = urls.judged(df, [r for r in RULES if r.host != "org"])
    got = {r.page_id: (r.verdict, r.component) for r in out.collect()}
    assert got.pop(20_001) == ("allow", None)
    assert len(got) == 10_003 and {v for v, _ in got.values()} == {"block"} and len({c for _, c in got.values()}) == 1
