"""Anchors of a page: attribute forms, nesting, breakage; choosing among them."""
from pyspark.sql import functions as F

from eraspark.functions import fixed
from eraspark.operators import links as L

PAGE = """<ul><li><a href='/one' title="เนื้อเพลง A" class="x song">A &amp; <b>b</b><!-- no --></a>
<li><A HREF=/two CLASS='songs'>two
<li><a>none</a><a href title>empty</a><a title='x &quot;y&quot;' href="/a?b=1&amp;c=2">q</a></ul>
<a href="/out">outer <a href="/in">inner</a> rest</a><script>var a = "<a href='/s'>s</a>";</script>
<a href="/hid"><script>hidden</script>seen<style>p{}</style></a><br/><a href="/self"/>tail
<a class="song" href="http://x.example/abs">abs</a></p>"""


def test_anchor_attributes_and_text():
    got = [(a["href"], a["title"], a["classes"], a["text"]) for a in L.anchors(PAGE)]
    assert got == [
        ("/one", "เนื้อเพลง A", ["x", "song"], "A & b"), ("/two", None, ["songs"], "two\nnoneemptyq"), (None, None, [], "none"),
        ("", "", [], "empty"), ("/a?b=1&c=2", 'x "y"', [], "q"), ("/out", None, [], "outer inner rest"), ("/in", None, [], "inner"),
        ("/hid", None, [], "seen"), ("/self", None, [], ""), ("http://x.example/abs", None, ["song"], "abs")]
    assert [a["pos"] for a in L.anchors(PAGE)] == list(range(1, 11))
    assert L.anchors(None) == [] and L.anchors("") == [] and L.anchors("<a href='/x") == []
    assert [a["text"] for a in L.anchors("<a href='/x'>cut off")] == ["cut off"]


def test_choosing_links(spark):
    pages = spark.createDataFrame([(1, "http://s.example/p", PAGE), (2, "http://s.example/q", None), (3, "http://s.example/r", "<p>no link")], "page_id long, url string, html string")
    links = L.page_links(pages)
    assert links.columns == ["page_id", "url", "pos", "href", "title", "classes", "text"]
    assert {r.href for r in L.by_href(links, "/o").collect()} == {"/one", "/out"}
    assert [r.href for r in L.by_title(links, fixed.SONG_TITLE_PREFIX).collect()] == ["/one"]
    assert {r.href for r in L.by_class(links, "song").collect()} == {"/one", "http://x.example/abs"}
    assert [r.href for r in L.first_by_class(links, "song").collect()] == ["/one"]
    assert L.page_links(pages.filter("page_id > 5")).count() == 0


def test_song_and_artist_worklists(spark):
    lyrics = fixed.SONG_TITLE_PREFIX
    html = "".join(f"<a title='{lyrics} x' href='{h}'>{t}</a>" for h, t in [("/1", "b"), ("/1", "a"), ("/2", lyrics), ("http://o.example/3", "c"), ("/4", "seen")])
    html += f"<a title='{lyrics}'>no address</a><a href='{fixed.ARTIST_HREF_PREFIX}z'>Z</a><a href='/z'>n</a>"
    links = L.page_links(spark.createDataFrame([(1, html)], "page_id long, html string"), keep=("page_id",))
    seen = spark.createDataFrame([("http://s/4",)], "url string")
    songs = sorted(tuple(r) for r in L.song_links(links, "http://s", seen).collect())
    assert songs == [("http://o.example/3", "c"), ("http://s/1", "a")]
    assert [tuple(r) for r in L.artist_links(links, F.lit("http://s")).collect()] == [(f"http://s{fixed.ARTIST_HREF_PREFIX}z", "Z")]


def test_requests(spark):
    s = spark.createDataFrame([(1, "a b", "c&d"), (2, "t", None), (3, None, "x")], "id long, title string, artist string")
    got = {(r.id, r.form): r.url for r in L.search_requests(s).collect()}
    assert got[1, "lyrics"] == fixed.LYRICS_SEARCH_URL + "a%20b%20c%26d" and got[2, "lyrics"] == fixed.LYRICS_SEARCH_URL + "t"
    assert got[1, "year"] == fixed.YEAR_SEARCH_URL + "c%26d%20a%20b%20%E0%B8%9B%E0%B8%B5"
    assert got[1, "plain"] == fixed.YEAR_SEARCH_URL + "a b+c&d+" + fixed.SEARCH_YEAR_KEYWORD
    assert got[1, "check"] == fixed.CHECK_SEARCH_URL + "a+b+c&d+" + fixed.CHECK_YEAR_KEYWORDS.replace(" ", "+")
    assert len(got) == 12
    urls = L.index_requests(spark.createDataFrame([("http://s",), ("http://s",)], "base string")).collect()
    assert len(urls) == len(fixed.THAI_INDEX_LETTERS) and {r.letter for r in urls} == set(fixed.THAI_INDEX_LETTERS)
