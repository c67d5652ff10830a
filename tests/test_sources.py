"""Fetching, feeds, files, the graph API and sinks."""

import gzip
import http.server
import threading

import pytest
from pyspark.sql import functions as F

from skein.sources import api, feed, fetch, search, sinks

FEEDS = {
    "rss": "<rss><channel><title>c</title><item><title>One</title><link>http://a/1</link><pubDate>Thu, 01 Jan 2004 19:48:21 GMT</pubDate><description>&lt;b&gt;x&lt;/b&gt;&lt;script&gt;y()&lt;/script&gt;</description><category>k</category><enclosure url='http://a/1.mp3'/></item><item><guid>http://a/2</guid></item></channel></rss>",
    "atom": "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>Two</title><link rel='alternate' href='http://b/1'/><link rel='enclosure' href='http://b/1.png'/><updated>2003-12-31T10:14:55Z</updated><category term='t'/><summary>s</summary></entry></feed>",
    "cdf": "<CHANNEL><ITEM HREF='http://c/1'><TITLE>Three</TITLE><ABSTRACT>abs</ABSTRACT></ITEM></CHANNEL>",
    "bad": "<rss><item>",
}


def test_feeds_of_all_kinds():
    one, two = feed.parse_feed(FEEDS["rss"])
    assert (one["title"], one["link"], one["content"], one["categories"], one["enclosures"]) == ("One", "http://a/1", "<b>x</b>", ["k"], ["http://a/1.mp3"]) and two["link"] == "http://a/2"
    (entry,) = feed.parse_feed(FEEDS["atom"])
    assert (entry["title"], entry["link"], entry["published"], entry["enclosures"]) == ("Two", "http://b/1", "2003-12-31T10:14:55Z", ["http://b/1.png"])
    (item,) = feed.parse_feed(FEEDS["cdf"])
    assert (item["title"], item["link"], item["content"]) == ("Three", "http://c/1", "abs")
    assert feed.parse_feed(FEEDS["bad"]) == feed.parse_feed(None) == []


def test_sanitized_html_keeps_allowed_tags_only():
    assert feed.sanitized('<p onclick="x()">a<IMG src=x><a href="javascript:y">b</a><a href="http://h/">c</a></p><style>z</style>') == '<p>a<a>b</a><a href="http://h/">c</a></p>'


def test_bytes_are_decoded_by_mark_name_or_guess(spark):
    raw = ["é".encode(), "é".encode("latin-1"), "<?xml version='1.0' encoding='iso-8859-1'?>é".encode("latin-1"), "é".encode("utf-16"), None]
    rows = spark.createDataFrame([(i, bytearray(r) if r is not None else None) for i, r in enumerate(raw)], "id int, raw binary")
    got = {r["id"]: r["t"] for r in rows.select("id", feed.decoded(F.col("raw")).alias("t")).collect()}
    assert got[0] == got[1] == got[3] == "é" and got[2].endswith("é") and got[4] is None


class _Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/gone":
            return self.send_error(404)
        if self.headers.get("If-None-Match") == "v1":
            self.send_response(304)
            return self.end_headers()
        body = b"" if self.path == "/empty" else gzip.compress(b"hello")
        self.send_response(200)
        self.send_header("ETag", "v1")
        if body:
            self.send_header("Content-Encoding", "gzip")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch_gives_errors_as_values(spark, site):
    urls = spark.createDataFrame([(f"{site}/a", None), (f"{site}/a?again", "v1"), (f"{site}/empty", None), (f"{site}/gone", None), ("http://127.0.0.1:1/", None), ("no url", None)], "url string, etag string")
    got = {r["url"].removeprefix(site): r for r in fetch.fetch(urls).collect()}
    assert (got["/a"]["status"], got["/a"]["body"], got["/a"]["etag"], got["/a"]["error"]) == (200, "hello", "v1", None)
    assert (got["/a?again"]["status"], got["/a?again"]["error"]) == (304, None)
    assert got["/empty"]["error"] == "empty" and got["/gone"]["error"] == "HTTP 404" and got["http://127.0.0.1:1/"]["error"] and got["no url"]["error"]


def test_acquire_files_urls_and_objects(spark, site, tmp_path):
    (tmp_path / "x.txt").write_text("ä\nb", encoding="utf-8")
    assert fetch.acquire(spark, str(tmp_path / "x.txt"), "f").first()["text"] == "ä\nb"
    assert fetch.acquire(spark, f"{site}/a", "u").first()["text"] == "hello"
    assert [r["text"] for r in fetch.acquire(spark, ["p", "q"], "o").collect()] == ["p", "q"]
    with pytest.raises(ValueError):
        fetch.acquire(spark, "x", "z")


def test_api_paths(spark):
    tables = {
        "concepts": spark.createDataFrame([(1, "en", "Dog", True)], "id long, lang string, text string, visible boolean"),
        "edges": spark.createDataFrame([(i, "en", 1, "IsA", 2 + i, float(i)) for i in range(150)], "id long, lang string, a long, rel string, b long, score double"),
    }
    get = lambda path, **how: api.get(path, lambda n: tables[n], **how)
    assert get("/en/concept/dog.json").first()["value"] == '{"id":1,"text":"Dog","visible":true}'
    assert get("/en/concept/dog/assertions.table", limit=1000).count() == 100 and get("/en/concept/dog/assertions.table").count() == 20
    assert get("/en/concept/dog/features.table", limit=5).count() == 5 and get("/en/assertion/7.table").first()["b"] == 9
    with pytest.raises(KeyError):
        get("/nowhere/at/all/x")


def test_requests_and_sinks(spark, tmp_path):
    assert search.requests(["a", "b"], ["c"], 150, 100) == [('"a" "b" -"c"', 0), ('"a" "b" -"c"', 100), ('"b" "a" -"c"', 0), ('"b" "a" -"c"', 100)]
    assert sinks.to_yaml([{"a": 1, "b": "x"}]) == '---\na: 1\nb: "x"\n'
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert [sinks.cached(spark, str(tmp_path / "c"), make).count() for _ in range(2)] == [3, 3] and made == [1]
