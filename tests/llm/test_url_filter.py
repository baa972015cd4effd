import duckdb
import pandas as pd

from wattloom.llm.url_filter import count_terms, filter_urls, url_sql

URLS = [
    "http://a.example.net/en/1", "http://a.example.net/de/1", "http://net/", "http://net", "https://EXAMPLE.com/de/x?y", "http://badexample.com/de/", "https://x.ORG/fr/a#b", "no scheme", "", None, "a://b://c/d",
    "http://h/xxx", "http://h/xxxy", "http://h/free-win", "http://h/free/free", "http://h?casino", "http://spam-farm.example.org/", "http://h/HOT/Loan", "http://user:pw@h:80/p", "http://é.org/fr/ü", "x\n://h\n/p",
    "http://h/" + "a/" * 50_000,
]


def test_against_sql(spark):
    rows = [(i, u, "x") for i, u in enumerate([*URLS, URLS[0]])]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).orderBy("page_id").toPandas()
    pages = pd.DataFrame({"page_id": range(len(rows)), "url": [r[1] for r in rows]})
    con = duckdb.connect()
    con.register("pages", pages)
    want = con.execute(url_sql()).df().sort_values("page_id").reset_index(drop=True)
    for c in ("host", "path", "rule", "verdict", "n_strict", "n_soft"):
        assert got[c].astype(object).where(got[c].notna(), None).tolist() == want[c].astype(object).where(want[c].notna(), None).tolist(), c
    by = dict(zip([r[1] for r in rows], got.itertuples(), strict=True))
    assert by["http://a.example.net/en/1"].verdict == "allow" and by["http://a.example.net/de/1"].rule == "net/" and by["http://net"].rule is None
    assert by["http://h/free-win"].verdict == "block" and by["http://h/free/free"].verdict == "allow" and by["http://h/xxxy"].verdict == "allow"
    assert filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_boundaries():
    assert count_terms("http://h/xxx.html") == (1, 0) and count_terms("axxx") == (0, 0) and count_terms("xxx1") == (0, 0) and count_terms(None) == (0, 0)
    assert count_terms("spam-farm") == (1, 1) and count_terms("éxxxé") == (1, 0)
