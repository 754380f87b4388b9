"""WARC derivatives: metadata and plain-text conversion records of responses (operator 10)."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynxframe.llm.common import lean

RECORD = "record_type string, record_id string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, block binary"
RESPONSES = f"page_id long, {RECORD}"
DERIVED = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, content_length long, block binary"

TAG = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/<>]*)[^<>]*>|<[!?][^<>]*>")
#: Elements whose content is no text, elements that may stand in a head, and elements that end a line.
SILENT = {"script", "style", "noscript", "template"}
IN_HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "title", *SILENT}
BREAKS = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "title", "tr", "ul"}


ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in (*SILENT, "head", "title")}
BODY = re.compile(r"<body(?=[\s/>])", re.I)


def sha1(data: bytes) -> str:
    """A digest as WARC headers have it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same record gets the same id in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def plain_text(source: str) -> str:
    """The text of a page: no comments, scripts, styles or head; block elements end lines; one pass over the source.

    A head ends at its end tag. Without one before the body, it ends where HTML ends it: at text or at the first element
    that cannot stand in a head.
    """
    out, at, end, head = [], 0, len(source), False
    while at < end:
        m = TAG.search(source, at)
        piece = source[at : m.start()] if m else source[at:]
        head = head and not piece.strip()
        if not head:
            out.append(piece)
        if not m:
            break
        at = m.end()
        if m[0] == "<!--":
            close = source.find("-->", at)
            at = end if close < 0 else close + 3
        elif m[2]:
            name = m[2].lower()
            if name == "head" and not m[1]:
                close = ENDS[name].search(source, at)
                body = BODY.search(source, at, close.start()) if close else None
                head = not close or bool(body)
                at = at if head else close.start()
                continue
            if head and not m[1]:
                head = name in IN_HEAD
            if not m[1] and (name in SILENT or (head and name == "title")):
                close = ENDS[name].search(source, at)
                at = close.start() if close else end
            elif name in BREAKS:
                out.append("\n")
    lines = (" ".join(x.split()) for x in html.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x)


def title(source: str) -> str:
    m = re.search(r"<title[^<>]*>([^<]*)", source, re.I)
    return " ".join(html.unescape(m[1]).split()) if m else ""


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def serialize(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC/1.1 record; fields without a value are left out, line breaks in values become spaces."""
    head = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _unzipped(data: bytes) -> tuple[bytes, int]:
    """The members of a gzip file in a row, and how many are broken; a broken one gives what could be read of it."""
    plain, broken = [], 0
    while data:
        unzip = zlib.decompressobj(31)
        try:
            plain.append(unzip.decompress(data))
            rest = unzip.unused_data
            broken += not unzip.eof
        except zlib.error:
            broken += 1
            # On to the next head of a member.
            unzip, rest = zlib.decompressobj(31), data[1:]
            plain.append(_readable(data))
        start = rest.find(b"\x1f\x8b\x08")
        if start < 0:
            break
        data = rest[start:]
    return b"".join(plain), broken


def _readable(data: bytes, step: int = 1024) -> bytes:
    """What a broken member gives up to where it breaks."""
    unzip, out = zlib.decompressobj(31), []
    try:
        for k in range(0, len(data), step):
            out.append(unzip.decompress(data[k : k + step]))
    except zlib.error:
        pass
    return b"".join(out)


def parse_records(data: bytes, skipped: list[str] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-case header fields, block) of the records of a WARC file, plain or gzip by record.

    A record without a length that is a number, or with less left than its length, is left out, as are bytes between
    records; reading goes on at the next record head (``WARC/`` at the start of a line). Of broken gzip members the
    readable part is taken. What was left out is named in ``skipped``.
    """
    skipped = [] if skipped is None else skipped
    if data[:2] == b"\x1f\x8b":
        data, broken = _unzipped(data)
        skipped += ["broken gzip member"] * broken
    heads = re.compile(rb"(?:^|(?<=\n))WARC/")
    at = 0
    while m := heads.search(data, at):
        at = m.start()
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            skipped.append("no end of head")
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = fields.get("content-length", "0")
        if not re.fullmatch("[0-9]{1,18}", size):
            skipped.append("length is no number")
            at += 5
        elif end + 4 + int(size) > len(data):
            skipped.append("shorter than its length")
            at += 5
        else:
            at = end + 4 + int(size)
            yield fields, data[end + 4 : at]


def response_records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """page_id and ``record``, a serialized response record, per row of ``pages`` (page_id, url, html).

    A null url gives a record without target; a null page is an empty payload; repeated rows give equal records.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, source in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                payload = (source or "").encode()
                block = http_block(payload)
                fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page), url or "", sha1(payload))), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", sha1(payload)), ("WARC-Block-Digest", sha1(block)), ("Content-Type", "application/http; msgtype=response")]
                out.append(serialize(fields, block))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, pa.binary())], ["page_id", "record"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(lean(build), "page_id long, record binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``record`` of every record in WARC files (plain or gzip by record), each serialized again without compression.

    A file is read whole by one task: keep files at the usual 1 GB or less.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                for fields, block in parse_records(data.as_py()):
                    kept = [(k, v) for k, v in fields.items() if k != "content-length"]
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([serialize(kept, block)], pa.binary())], ["page_id", "record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lean(run), "page_id long, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record per response among ``records`` (page_id, record).

    Both refer to the response by its id, keep its target, date and payload digest, and have a digest of their own
    block; the metadata block lists the conversion's id, the source's headers, title and sizes; the conversion block is
    the page's plain text. Records of other types, and rows without a record, give none; a response without a target or
    date leaves those null; an empty payload gives an empty conversion. Returns DERIVED's columns, block as bytes.
    """

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, data in zip(batch.column("page_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
                for fields, block in parse_records(data or b""):
                    if fields.get("warc-type") != "response":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    source = payload.decode("utf-8", "replace")
                    own, target, date = fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date")
                    digest = fields.get("warc-payload-digest") or sha1(payload)
                    text = plain_text(source).encode()
                    conversion = record_id("conversion", own or "", digest)
                    headers = [f"source-{k}: {v}" for k, v in fields.items() if k.startswith("warc-")] + [f"http-{x}" for x in head.decode("utf-8", "replace").split("\r\n")[1:]]
                    about = "\r\n".join([f"conversion-id: {conversion}", *headers, f"title: {title(source)}", f"payload-bytes: {len(payload)}", f"text-bytes: {len(text)}", ""]).encode()
                    for kind, rid, content, body in (("metadata", record_id("metadata", own or "", digest), "application/warc-fields", about), ("conversion", conversion, "text/plain; charset=utf-8", text)):
                        out.append((page, kind, rid, own, target, date, content, digest, sha1(body), len(body), body))
            if out:
                kinds = [pa.int64(), *[pa.string()] * 8, pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in DERIVED.split(", ")])

    return records.select("page_id", "record").mapInArrow(lean(derive), DERIVED)


def to_warc(derived: DataFrame) -> DataFrame:
    """page_id, record_type, record: the derivatives serialized, in a form that ``read_warc``'s parser reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                fields = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["warc_date"]), ("WARC-Payload-Digest", r["payload_digest"]), ("WARC-Block-Digest", r["block_digest"]), ("Content-Type", r["content_type"])]
                out.append(serialize(fields, r["block"] or b""))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("record_type"), pa.array(out, pa.binary())], ["page_id", "record_type", "record"])

    return derived.mapInArrow(lean(run), "page_id long, record_type string, record binary")
