import base64
import hashlib
from pathlib import Path

import pytest

from plumbline.llm import html, warc

ARTICLE = "First paragraph, with commas, and enough text to earn points. " * 3


@pytest.mark.parametrize("page", [
    "<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>{a}</p><p>Short &amp;&nbsp;sweet.</p></article><footer>f</footer></body></html>",
    "<body class='has-sidebar'><div id=menu>m, m, m, m, m, m, m, m, m, m, m, m</div><div class=content><h1>Head</h1><p>{a}<p>Short &#38;\n\n sweet.</div><div class='comments'><p>{a}{a}</p></div></body>",
    "<div class=wrap><header><h1>Site</h1></header><main><h1>Head</h1><section><p>{a}</p></section><p>Short <b>&amp; sw</b>eet.<script>var x = '</p><p>no</p>';</script></p><form>Sign up, now, please <input></form><aside>{a}</aside></main></div>",
    "<article><h1>Head</h1><p><b>{a}<br><p>Short <i>&amp;</i> sweet.<!-- <p>hidden</p> --><div class='ad-box'>Buy, buy, buy</div><p style='display: none'>{a}</p>",
    "<body><div><div class='cookie-notice'>We, use, cookies, and, more, and, more, and, yet, more</div><div><h1>Head</h1><p>{a}</p><p>Short &amp; sweet.</p><ul><li><a href=1>One link</a></li><li><a href=2>Two link</a></li></ul></div></div></body>",
    "<body><article class='post social'><h1>Head</h1><p>{a}</p><p>Short &amp; sweet.</p></article><section id=comments><h2>3 comments</h2><article class=comment><p>{a}{a}</p></article></section></body>",
])
def test_main_text(page):
    assert html.main_text(page.replace("{a}", ARTICLE)) == f"Head\n{ARTICLE.strip()}\nShort & sweet."


def test_odd_pages():
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == html.main_text("<script>x</script>") == ""
    assert html.main_text("plain words") == "plain words"
    assert html.main_text("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"
    assert html.main_text("<p>a < b & c &lt;p&gt; <") == "a < b & c <p> <"
    assert html.main_text("<article><p>x<p a='>'>y</article>") == "x\ny"
    long = "<article>" + "<p>word, word</p>" * 20000 + "</article>"
    assert html.main_text(long).count("\n") == 19999


def test_table_of_pages(spark, sf):
    pages = spark.createDataFrame([(1, "u", "<p>é😀</p>", 3), (2, None, None, 4), (None, "u", "", 5), (1, "u", "<p>é😀</p>", 3)], "page_id long, url string, html string, text int")
    rows = sorted(((r.page_id or 0), r.text, r.n_chars) for r in html.extract(pages).collect())
    assert rows == [(0, "", 0), (1, "é😀", 2), (1, "é😀", 2), (2, "", 0)]
    assert html.extract(pages.limit(0)).collect() == []
    own = html.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert all(r.text and r.n_chars == len(r.text) for r in own)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_round_trip(spark):
    texts = {1: "a\r\n\r\nb", 2: "é" * 5000, 3: None, 4: "", 5: "é" * 5000, 6: "a\r\n\r\nb", 7: "WARC/1.1\r\n", 8: "x"}
    pages = spark.createDataFrame([(i, "http://h/ é\r\n" if i % 2 else None, t, 0) for i, t in texts.items()], "page_id long, url string, html string, sha int").repartition(2, "page_id")
    bundles = warc.write_bundles(pages, frame_bytes=2000, bundle_bytes=500)
    rows = {r.page_id: r for r in warc.read_bundles(bundles).collect()}
    assert set(rows) == set(texts)
    refers = {4: 3, 5: 2, 6: 1}
    for i, t in texts.items():
        r = rows[i]
        assert (r.payload_bytes, r.payload_digest) == (len((t or "").encode()), digest(t))
        assert (r.record_type, r.refers_to) == (("revisit", refers[i]) if i in refers else ("response", None))
        assert r.payload is None if i in refers else bytes(r.payload) == (t or "").encode()
    few = {r.page_id: r.refers_to for r in warc.read_bundles(warc.write_bundles(pages, min_bytes=100)).collect()}
    assert few == {i: 2 if i == 5 else None for i in texts}


def test_bundles_are_seekable_files(spark, tmp_path):
    import io

    import zstandard

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 200) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    bundles = warc.write_bundles(pages, frame_bytes=4000)
    (path,) = map(Path, warc.export_bundles(bundles, tmp_path))
    data = path.read_bytes()
    frames = warc.read_seek_table(data)
    assert len(frames) > 5 and sum(f[1] for f in frames) < len(data)
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 50
    name, frame, offset = path.with_suffix(".idx").read_text().splitlines()[37].split("\t")
    head, payload, _ = warc.parse_record(warc.read_frame(data, int(frame)), int(offset))
    assert head["WARC-Record-ID"] == name == "<urn:page:37>" and payload == b"<p>37</p>" * 200


def test_records_are_read_by_their_identifier(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 40}</p>" * 200) for i in range(50)], "page_id long, url string, html string").repartition(2, "page_id")
    bundles = warc.write_bundles(pages, frame_bytes=4000, bundle_bytes=2000)
    index = warc.record_index(bundles)
    assert index.count() == 50 and index.where("record_id = '<urn:page:37>'").count() == 1
    wanted = spark.createDataFrame([("<urn:page:37>",), ("<urn:page:45>",), ("<urn:page:3>",), ("<urn:page:3>",), ("<urn:page:99>",), (None,)], "record_id string")
    rows = {r.page_id: (r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in warc.read_records(bundles, index, wanted).collect()}
    assert rows == {37: ("response", None, b"<p>37</p>" * 200), 3: ("response", None, b"<p>3</p>" * 200), 45: ("revisit", 5, None)}
    footers = bundles.where("size(record_ids) = 0").collect()
    for r in footers:
        frames = bundles.where((bundles.bundle_id == r.bundle_id) & (bundles.frame < r.frame)).orderBy("frame").collect()
        assert [(f[1]) for f in warc.read_seek_table(bytes(r.data))] == [len(f.data) for f in frames]


def test_rows_that_share_an_identifier_keep_their_payloads(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (2, "u", "b"), (3, "u", "b"), (3, "u", "a")], "page_id long, url string, html string")
    rows = sorted((r.page_id, r.record_type, r.refers_to or 0, r.payload_digest) for r in warc.read_bundles(warc.write_bundles(pages)).collect())
    assert rows == sorted([(1, "response", 0, digest("a")), (2, "revisit", 1, digest("a")), (2, "response", 0, digest("b")), (3, "revisit", 2, digest("b")), (3, "revisit", 1, digest("a"))])


def test_empty_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_bundles(warc.write_bundles(empty)).count() == 0
    odd = spark.createDataFrame([(None, "u", "x"), (1, "u", "x"), (1, "u", "x")], "page_id long, url string, html string")
    rows = sorted((r.page_id or 0, r.record_type) for r in warc.read_bundles(warc.write_bundles(odd)).collect())
    assert rows == [(0, "response"), (1, "response"), (1, "response")]
