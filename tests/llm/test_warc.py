import base64
import hashlib
import html
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF001
from velora.llm import warc as W


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_plain_text():
    page = (
        "<!DOCTYPE html><html lang='fr'><head><title>A &amp; B</title><style>p{}</style><script>if (a<b) x('</p>')</script></head>"
        "<body><p>One&nbsp;<b>tw</b>o<br>three</p><!-- no <p>no</p> --><div title='a>b'>f&#233;e &lt;x&gt;</div></body></html>"
    )
    assert W.plain_text(page) == "A & B\nOne two\nthree\nfée <x>"
    assert W.plain_text(None) == W.plain_text("") == ""
    assert W.plain_text("a <!-- never closed <p>b") == "a"
    assert W.plain_text("1 < 2 and <3") == "1 < 2 and <3"


@given(st.lists(st.text(alphabet="abc &<>\"'é", min_size=1, max_size=12), max_size=6))
@settings(max_examples=60, deadline=None)
def test_escaped_paragraphs_come_back(paragraphs):
    page = "".join(f"<p>{html.escape(x)}</p>" for x in paragraphs)
    assert W.plain_text(page).split("\n") == ([" ".join(x.split()) for x in paragraphs if x.split()] or [""])


def responses(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_records_are_linked_and_digests_hold(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    source = {r.page_id: r for r in W.responses_of_pages(pages).collect()}
    got = W.build_derivatives(W.responses_of_pages(pages)).collect()
    assert len(got) == 2 * pages.count()
    by = {(r.page_id, r.record_type): r for r in got}
    for page_id, s in source.items():
        meta, text = by[page_id, "metadata"], by[page_id, "conversion"]
        assert meta.refers_to == text.refers_to == s.record_id
        assert text.block == W.plain_text(s.payload)
        assert f"conversion-record: {text.record_id}" in meta.block and f"WARC-Concurrent-To: {meta.record_id}" in text.headers
        for h in s.http_headers.splitlines():
            assert f"source-header: {h}" in meta.block
        for r in (meta, text):
            data = r.block.encode()
            assert r.block_digest == sha1(data) and r.content_length == len(data)
            assert r.payload_digest == sha1(s.payload.encode()) and f"WARC-Refers-To: {s.record_id}" in r.headers
    assert len({r.record_id for r in got}) == len(got)


def test_written_files_parse_back(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>page {i} é\r\n\r\nWARC/1.1\r\n</p>") for i in range(30)] + [(99, None, None)]
    records = W.build_derivatives(W.responses_of_pages(responses(spark, rows)))
    W.write_warc(records, str(tmp_path / "w"), compression="none")
    found = [x for f in sorted((tmp_path / "w").glob("part-*")) for x in W.parse_warc(f.read_bytes())]
    assert sorted((h["WARC-Record-ID"], b.decode()) for h, b in found) == sorted((r.record_id, r.block) for r in records.collect())
    assert all(h["WARC-Block-Digest"] == sha1(b) for h, b in found)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "http://a", "<p>x</p>"), (1, "http://a", "<p>x</p>"), (None, None, None), (2, "", ""), (3, "u\r\nv", "<p>" + "long " * 200_000)]
    df = W.responses_of_pages(responses(spark, rows))
    from pyspark.sql import functions as F

    got = W.build_derivatives(df.withColumn("block", F.lit("clash")).withColumn("note", F.lit(1))).collect()
    assert len(got) == 10 and all(r.note == 1 for r in got)
    assert len({r.record_id for r in got}) == 8
    assert all("WARC-Target-URI" not in r.headers for r in got if r.target_uri is None)
    assert W.build_derivatives(df.limit(0)).collect() == []


def test_a_megabyte_of_hostile_markup_takes_seconds():
    for unit in ("<title>x ", "<title ", "<a href ", "<html lang", "<!-- ", "<script>", "</script ", "<p '", '<p "a" ', "&amp", "x"):
        page = unit * (1_000_000 // len(unit))
        t = time.monotonic()
        records = W.derivatives({"record_id": "r", "target_uri": "u", "date": "d", "http_headers": None, "payload": page})
        assert len(records) == 2 and time.monotonic() - t < 10, unit


def test_title_of_the_first_element():
    assert W.page_title("<TITLE lang=x>A <b>b</b></Title><title>c</title>") == "A b"
    assert W.page_title("</title><title>never closed") == W.page_title("no title") == W.page_title("") == ""
