"""WARC derivatives (operator 4): linked metadata and plain-text conversion records of responses.

Every response gives two records that refer to it by WARC-Refers-To, keep its
target, date and payload digest, and name each other (the conversion record in
the metadata block). Record ids are UUIDs of the response id and the record
type, so a rerun or a retried task gives the same records. Digests are
``sha1:`` and base32, over the bytes of the block, as in crawl archives.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "WARC/1.1"
EOL = "\r\n"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:velora:warc")
#: Elements whose content is no text, and elements that end a line: fixed values of HTML.
_SKIPPED = "script|style|noscript|template|svg|iframe|object|canvas"
_BLOCKS = frozenset(
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main nav ol option p pre section select table tbody td tfoot th thead title tr ul".split()
)
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_SKIPPED})\b[^<>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*>|<[!?][^<>]*>",
    re.IGNORECASE | re.DOTALL,
)
_TITLE = re.compile(r"<title\b[^<>]*>", re.IGNORECASE)
_TITLE_END = re.compile(r"</title", re.IGNORECASE)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.IGNORECASE)
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*[\"']?([^\"'<>\s]+)", re.IGNORECASE)
_BLANKS = re.compile(r"[^\S\n]+")

RECORD = (
    T.StructType()
    .add("record_type", T.StringType())
    .add("record_id", T.StringType())
    .add("refers_to", T.StringType())
    .add("target_uri", T.StringType())
    .add("content_type", T.StringType())
    .add("content_length", T.LongType())
    .add("block_digest", T.StringType())
    .add("payload_digest", T.StringType())
    .add("headers", T.StringType())
    .add("block", T.StringType())
)


def plain_text(source: str | None) -> str:
    """The text of a page: no markup, scripts, styles or comments; block elements end lines; entities decoded.

    Runs of blanks become one, empty lines go. Unclosed comments and scripts run to the end.
    """
    if not source:
        return ""

    def replace(m: re.Match) -> str:
        tag = m.group("tag")
        return "\n" if tag and tag.lower() in _BLOCKS else "" if tag else " "

    text = html.unescape(_MARKUP.sub(replace, source))
    lines = (_BLANKS.sub(" ", x).strip() for x in text.replace("\r", "\n").split("\n"))
    return "\n".join(x for x in lines if x)


def page_title(source: str) -> str:
    """The text of the first title element; without an end tag behind its start there is none. Two searches, so linear on any text."""
    start = _TITLE.search(source)
    end = start and _TITLE_END.search(source, start.end())
    return plain_text(source[start.end() : end.start()]) if end else ""


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join('' if p is None else p for p in parts))}>"


def _clean(value: str) -> str:
    """A header value holds no line break."""
    return " ".join(value.split())


def _record(kind: str, rid: str, response: dict, content_type: str, block: str, extra: list[tuple[str, str]]) -> tuple:
    data = block.encode("utf-8", "surrogatepass")
    block_digest = digest(data)
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", rid),
        ("WARC-Refers-To", response["record_id"]),
        ("WARC-Target-URI", response["target_uri"]),
        ("WARC-Date", response["date"]),
        ("WARC-Block-Digest", block_digest),
        *extra,
        ("Content-Type", content_type),
        ("Content-Length", str(len(data))),
    ]
    head = EOL.join([VERSION, *(f"{k}: {_clean(v)}" for k, v in fields if v)])
    return (
        kind, rid, response["record_id"], response["target_uri"], content_type, len(data), block_digest,
        response["payload_digest"], head, block,
    )


def derivatives(response: dict) -> list[tuple]:
    """The metadata and the conversion record of one response (record_id, target_uri, date, http_headers, payload)."""
    source = response["payload"] or ""
    response = response | {"payload_digest": digest(source.encode("utf-8", "surrogatepass"))}
    meta_id, text_id = (record_id(response["record_id"], kind) for kind in ("metadata", "conversion"))
    lang = _LANG.search(source)
    fields = [
        ("conversion-record", text_id),
        ("source-payload-digest", response["payload_digest"]),
        ("source-length", str(len(source.encode("utf-8", "surrogatepass")))),
        *(("source-header", h) for h in (response["http_headers"] or "").splitlines() if h.strip()),
        ("title", page_title(source)),
        ("language", lang.group(1).lower() if lang else ""),
        *(("outlink", html.unescape(x)) for x in dict.fromkeys(_LINK.findall(source))),
    ]
    block = "".join(f"{k}: {_clean(v)}{EOL}" for k, v in fields if v)
    return [
        _record("metadata", meta_id, response, "application/warc-fields", block, [("WARC-Payload-Digest", response["payload_digest"])]),
        _record(
            "conversion", text_id, response, "text/plain; charset=utf-8", plain_text(source),
            [("WARC-Source-Payload-Digest", response["payload_digest"]), ("WARC-Concurrent-To", meta_id)],
        ),
    ]


def build_derivatives(responses: DataFrame) -> DataFrame:
    """Two records for every row of ``responses`` (record_id, target_uri, date, http_headers, payload; all text).

    A null payload is empty, other null fields are left out of the headers.
    Repeated rows give repeated records with the same ids. Work stays in the
    row's task: no shuffle. All columns of ``responses`` but the payload come along first.
    """

    @F.pandas_udf(T.ArrayType(RECORD))
    def build(
        ids: pd.Series, targets: pd.Series, dates: pd.Series, heads: pd.Series, payloads: pd.Series
    ) -> pd.Series:
        out = []
        for rid, target, date, head, payload in zip(ids, targets, dates, heads, payloads):
            rows = derivatives({"record_id": rid, "target_uri": target, "date": date, "http_headers": head, "payload": payload})
            out.append([dict(zip(RECORD.names, r)) for r in rows])
        return pd.Series(out)

    needed = ["record_id", "target_uri", "date", "http_headers", "payload"]
    kept = [c for c in responses.columns if c not in needed and c not in RECORD.names]
    return responses.select(*kept, F.explode(build(*needed)).alias("__r")).select(*kept, "__r.*")


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages (page_id, url, html): id from page_id and url, headers of a plain answer."""
    payload = F.coalesce(F.col("html"), F.lit(""))

    @F.pandas_udf(T.StringType())
    def named(ids: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([record_id("response", i, u) for i, u in zip(ids, urls)], dtype=object)

    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(
        "page_id",
        named(F.col("page_id").cast("string"), F.col("url")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        head.alias("http_headers"),
        payload.alias("payload"),
    )


def write_warc(records: DataFrame, folder: str, compression: str = "gzip") -> None:
    """Writes records as WARC files, one per task; a record ends with two line breaks, which is Spark's line separator here."""
    text = F.concat("headers", F.lit(EOL + EOL), "block")
    records.select(text.alias("value")).write.option("lineSep", EOL + EOL).option("compression", compression).text(folder)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed file, by Content-Length."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split(EOL)
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4
