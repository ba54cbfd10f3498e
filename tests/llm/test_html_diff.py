"""Extraction against a pairing over all pages of a host in plain Python."""

import random

import __spark_entry__
from tessella.llm import html_diff


def _pages() -> list[tuple]:
    rng = random.Random(11)
    menu = "<ul>" + "".join(f"<li>{x}</li>" for x in ("Home", "About", "Contact")) + "</ul>"
    page = lambda k: f"<html><body>{menu}<p>story {k} {rng.random()}</p><div>foot</div><p>tail {k % 3}</p></body></html>"
    rows = [(i, f"https://big.example/{rng.choice('abc')}/{rng.choice(['x', 'x-1', 'y'])}/{i}?q=1", page(i)) for i in range(300)]
    rows += [(1000, "http://alone.example/a", page(1)), (1001, "http://twins.example/a", "<p>same</p>"), (1002, "http://twins.example/b", "<p>same</p>")]
    rows += [(1003, None, page(2)), (1004, "http://big.example/z", None), (1005, "http://big.example/empty", ""), (1006, "http://BIG.example:80/a/x/", rows[0][2]), (None, "http://big.example/n", page(5)), rows[7]]
    rows += [(1007, "http://sh.example/a", "<p>one</p><p>two</p>"), (1008, "http://sh.example/b", "<p>one</p><p>two</p><p>three</p>")]
    return rows


def _brute(rows: list[tuple]) -> list[tuple]:
    places: dict[str, dict[str, list[str]]] = {}
    for _, url, html in rows:
        if url is not None and html is not None:
            host, path = html_diff.split_url(url)
            places.setdefault(host, {}).setdefault("\n".join(html_diff.lines_of(html)), []).append(path)
    out = []
    for page, url, html in rows:
        if url is None or html is None:
            out.append((page, None, None, None))
            continue
        host, _ = html_diff.split_url(url)
        text = "\n".join(html_diff.lines_of(html))
        order = sorted(((min(p, key=lambda x: x.split("/")), t) for t, p in places[host].items()), key=lambda x: x[0].split("/"))
        at = next(k for k, x in enumerate(order) if x[1] == text)
        near = [order[k] for k in (at - 1, at + 1) if 0 <= k < len(order)]
        best = max(near, key=lambda x: html_diff.closeness(order[at][0], x[0]), default=None)  # the first of equals: the predecessor
        own = text.split("\n") if text else []
        left = [own[i] for i in html_diff.unshared(own, best[1].split("\n") if best and best[1] else [])]
        out.append((page, "\n".join(left), len(own), len(own) - len(left)))
    return out


def test_extract_equals_brute_force_across_pieces(spark, tmp_path):
    rows = _pages()
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for pieces in (1, 7, 60):
            spark.conf.set("spark.sql.shuffle.partitions", pieces)
            got = [tuple(r) for r in __spark_entry__.queries()["op6_html_diff"](spark, str(tmp_path)).collect()]
            assert sorted(got, key=str) == sorted(_brute(rows), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_defined_results(spark):
    got = {r.page_id: tuple(r)[1:] for r in html_diff.extract(spark.createDataFrame(_pages(), "page_id long, url string, html string")).collect()}
    assert got[1000][2] == 0 and got[1000][1] == 6
    assert got[1001] == got[1002] == ("same", 1, 0)
    assert got[1003] == got[1004] == (None, None, None)
    assert got[1005] == ("", 0, 0)
    assert got[1007] == ("", 2, 2) and got[1008] == ("three", 3, 2)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_diff.extract(empty).collect() == []


def test_unshared_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            above = row[:]
            for j, y in enumerate(b):
                row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
        assert len(a) - len(html_diff.unshared(a, b)) == row[-1]


def test_broken_markup():
    lines = html_diff.lines_of
    assert lines("<html><head><title>T</title><body><p>hello</p>") == ["hello"]
    assert lines("<head><style>x<p>hello</p>") == []
    assert lines("a < b <p x>c") == ["a < b", "c"]
    assert lines("<p title=it's>a</p><p title=\"x>y\">b</p>") == ["a", "b"]
    assert lines("<p title=\"x>a<b>b</b>") == ["ab"]
    assert lines("one<!-- x --> two<br>three &amp; four<script>if (a<b) '</p>'</script>!") == ["one two", "three & four !"]
    assert lines("x<svg><p>y") == ["x", "y"]
    assert lines("") == lines("<") [:0] and lines("a<") == ["a<"]


def test_broken_markup_takes_linear_time():
    import time

    began = time.process_time()
    for part in ('<a href="x ', "<p x", "<p title='", "<svg>", "<head>", "<!x", "<a href= ", "</", "<script"):
        html_diff.lines_of(part * 40000)
    assert time.process_time() - began < 10


def test_clashing_columns_and_very_long_pages(spark):
    rows = [(1, "http://h.example/a", "<p>m</p>" * 20000, "k"), (2, "http://h.example/b", "<p>m</p>" * 19999 + "<p>z</p>", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").selectExpr("*", "1 as sign", "2 as keep", "3 as near")
    got = {r.page_id: tuple(r)[1:] for r in html_diff.extract(df).collect()}
    assert got == {1: ("m", 20000, 19999), 2: ("z", 20000, 19999)}
