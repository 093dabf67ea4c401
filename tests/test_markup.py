from kinetext.sources import html, markup

PAGE = """<!-- <table><tr><td>no</td></tr> --><script>var t = "<table><tr><td>no</td></tr>";</script>
<table><thead><tr><th title="a > b">Name<th>Files</th><th>Name</th></tr></thead>
<tr><td rowspan=2>one &amp; two<td><a href='x.srt'>get</a> <a href='y'>more</a><td>c
<tr><td>no link<!-- <tr><td>no</td> --></td>
<tr><td colspan="2">wide<table><tr><th>In</th></tr><tr><td><a href="/z">inner</a></td></tr></table> end</td><td>last</td></tr>
</table><table><tr><td>without a header</td></tr></table>"""


def shown(page):
    return [(t, y, [c[0] for c in cells]) for t, y, cells in markup.tables_of(page)]


def test_grids():
    assert shown(PAGE) == [
        (0, 0, ["Name", "Files", "Name"]), (0, 1, ["one & two", "get more", "c"]), (0, 2, ["one & two", "no link"]), (0, 3, ["wide end", "wide end", "last"]),
        (1, 0, ["In"]), (1, 1, ["inner"]), (2, 0, ["without a header"]),
    ]
    assert shown(None) == shown("") == shown("<td>no table") == []
    assert shown("<table><td>a<td>b</table>") == [(0, 0, ["a", "b"])]
    assert shown("<table><tr><td rowspan=0>all<td>x<tr><td>y<tr></table>") == [(0, 0, ["all", "x"]), (0, 1, ["all", "y"]), (0, 2, ["all"])]
    assert len(markup.tables_of("<table><tr><td colspan=99999999 rowspan=-1>x</table>")[0][2]) == 1000
    assert shown("<table><tr><td>never closed") == [(0, 0, ["never closed"])]


def test_rows_by_header(spark):
    pages = spark.createDataFrame([(1, "http://h.org/d/p.html", PAGE), (2, "http://h.org/", None)], "page_id int, url string, html string")
    got = [(r["row_no"], {k: (v["text"], v["link"]) for k, v in r["cells"].items()}) for r in html.table_rows(pages).orderBy("row_no").collect()]
    assert got == [
        (0, {"Name": ("one & two", None), "Files": ("get more", "http://h.org/d/x.srt")}), (1, {"Name": ("one & two", None), "Files": ("no link", None)}),
        (2, {"Name": ("wide end", None), "Files": ("wide end", None)}), (3, {"In": ("inner", "http://h.org/z")}),
    ]
    assert [r["row_no"] for r in html.table_rows(pages, "Files", 3).collect()] == [0]
