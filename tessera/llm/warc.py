"""WARC derivatives: metadata and plain-text conversion records of responses.

A response record becomes two linked records.  The metadata record (JSON) holds the source's headers, HTTP
status and headers, title and absolute links; the conversion record holds plain text.  Both carry
WARC-Refers-To with the response's id, its target URI and date, and block digests of their own; the
response's payload digest is kept in the metadata.  Ids are derived from the response's id, so a repeated task
gives the same records.  One scan, no shuffle; each record is handled whole.

Defined results: null or empty block: status null, no headers, no links, empty text; transfer and content codings are taken off where they can be; bytes that are not valid in their charset
are replaced; repeated headers keep all values; a null URI resolves no relative links; repeated rows give repeated records; an empty table gives an empty
table; other columns are passed on, except those with a result's name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "tessera:warc")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*)([^>]*)>|([^<]+)|<[!?][^>]*>|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z:_-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
_LINK = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action"}
RECORD = "metadata_id string, conversion_id string, refers_to string, status int, title string, n_links long, links array<string>, payload_digest string, metadata string, metadata_digest string, text string, text_digest string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}:{of}')}>"


def split_http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """(status, headers, payload) of an HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, payload = block.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()
    m = re.match(r"HTTP/\d\S*\s+(\d{3})", lines[0]) if lines else None
    if not m:
        return None, [], block
    return int(m[1]), [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k.strip()], payload


def unchunked(data: bytes) -> bytes:
    """The content of a chunked transfer; as it is, if it does not follow that form."""
    out, at = [], 0
    while True:
        stop = data.find(b"\r\n", at)
        size = data[at:stop].split(b";")[0].strip() if stop >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return data
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(data[stop + 2 : stop + 2 + n])
        at = stop + 2 + n + 2
        if at > len(data):
            return b"".join(out)


def content(http: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without its transfer and content codings; what cannot be decoded stays as it is."""
    named = {k.lower(): v.lower() for k, v in http}
    if "chunked" in named.get("transfer-encoding", ""):
        payload = unchunked(payload)
    for coding in reversed([x.strip() for x in named.get("content-encoding", "").split(",") if x.strip()]):
        for bits in {"gzip": (47,), "x-gzip": (47,), "deflate": (15, -15)}.get(coding, ()):
            try:
                d = zlib.decompressobj(bits)
                payload = d.decompress(payload) + d.flush()
                break
            except zlib.error:
                continue
    return payload


def page(source: str, base: str | None) -> tuple[str, list[str], str]:
    """(title, links in order of first appearance, plain text) of HTML."""
    out: list[str] = []
    links: dict[str, None] = {}
    title: list[str] | None = None
    done = ""
    for m in _TOKEN.finditer(source):
        text, tag = m[5], (m[3] or "").lower()
        if text is not None:
            t = html.unescape(text)
            if title is not None:
                title.append(t)
            else:
                out.append(t)
        elif tag:
            if tag == "title":
                if not m[2]:
                    title = []
                elif title is not None:
                    done, title = done or " ".join("".join(title).split()), None
            if tag in _BLOCK:
                out.append("\n")
            if not m[2] and (want := _LINK.get(tag)):
                for a in _ATTRIBUTE.finditer(m[4]):
                    if a[1].lower() == want:
                        link = html.unescape(next(x for x in a.groups()[1:] if x is not None)).strip()
                        try:
                            links.setdefault(urljoin(base or "", link))
                        except ValueError:
                            links.setdefault(link)
                        break
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return done, list(links), "\n".join(x for x in lines if x)


def _grouped(headers: list[tuple[str, str]]) -> dict:
    """Name -> value, or all values of a repeated name in order."""
    out: dict[str, list[str]] = {}
    for k, v in headers:
        out.setdefault(k, []).append(v)
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


def derive_one(response_id: str, uri: str | None, date: str | None, block: bytes | None, headers: list[tuple[str, str]]) -> dict:
    status, http, payload = split_http(block or b"")
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = (re.search(r"charset=[\"']?([\w.:-]+)", kind) or [None, "utf-8"])[1]
    try:
        source = content(http, payload).decode(charset, "replace")
    except LookupError:
        source = content(http, payload).decode("utf-8", "replace")
    title, links, text = page(source, uri)
    meta_id, conv_id = record_id("metadata", response_id), record_id("conversion", response_id)
    meta = json.dumps({
        "Envelope": {"WARC-Header-Metadata": _grouped(headers), "Payload-Digest": digest(payload), "Actual-Content-Length": len(block or b"")},
        "Response": {"Status": status, "Headers": http}, "HTML": {"Title": title, "Links": links},
        "Conversion": {"WARC-Record-ID": conv_id}}, ensure_ascii=False, separators=(",", ":"))
    return {"metadata_id": meta_id, "conversion_id": conv_id, "refers_to": response_id, "status": status, "title": title, "n_links": len(links), "links": links,
            "payload_digest": digest(payload), "metadata": meta, "metadata_digest": digest(meta.encode()), "text": text, "text_digest": digest(text.encode("utf-8", "replace"))}


_KIND = pa.struct([(n, pa.list_(pa.string()) if n == "links" else pa.int32() if n == "status" else pa.int64() if n == "n_links" else pa.string())
                   for n in [x.split()[0] for x in RECORD.split(", ")]])


def derive(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``responses`` (record_id, uri, date: string; headers array of (name, value); block binary) with the fields of ``RECORD``."""
    made = [x.split()[0] for x in RECORD.split(", ")]
    used = ["record_id", "uri", "date", "headers", "block"]
    keep = [c for c in (responses.columns if keep is None else keep) if c not in made and c != "block"]
    schema = ", ".join([f"`{c}` {responses.schema[c].dataType.simpleString()}" for c in keep] + [RECORD])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                cols = [part.column(len(keep) + j).to_pylist() for j in range(5)]
                rows = [derive_one(r or "", u, d, x, [(y["name"], y["value"]) for y in h or () if y]) for r, u, d, h, x in zip(*cols, strict=True)]
                got = pa.array(rows, _KIND)
                yield pa.RecordBatch.from_arrays([*[part.column(j) for j in range(len(keep))], *got.flatten()], [*keep, *made])

    return responses.select(*keep, *[F.col(c).alias(f"_{c}") for c in used]).mapInArrow(run, schema)


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of page_id, url and html, as a crawler would have written them."""
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    h = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url"))
    rid = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", rid.alias("record_id"), F.col("url").alias("uri"), F.lit(date).alias("date"), F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in [
        ("WARC-Type", F.lit("response")), ("WARC-Record-ID", rid), ("WARC-Target-URI", F.coalesce("url", F.lit(""))), ("WARC-Date", F.lit(date)),
        ("Content-Type", F.lit("application/http; msgtype=response"))]]).alias("headers"), F.concat(F.encode(head, "utf-8"), body).alias("block"))


def serialize(kind: str, rid: str, uri: str | None, date: str | None, refers_to: str | None, content_type: str, block: bytes) -> bytes:
    """One gzip member that holds one record."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Refers-To", refers_to),
              ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return gzip.compress(head.encode("utf-8", "replace") + block + b"\r\n\r\n", 6, mtime=0)


_RECORD = "kind string, derived_id string, refers_to string, uri string, date string, status int, title string, n_links long, payload_digest string, block_digest string, block_bytes long, record binary"


def records(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Two rows for each response, with the fields of ``_RECORD``: its metadata and its conversion record, serialized."""
    made = [x.split()[0] for x in _RECORD.split(", ")]
    derived = derive(responses)
    keep = [c for c in (responses.columns if keep is None else keep) if c not in (*made, "headers", "block")]
    used = ["metadata_id", "conversion_id", "refers_to", "uri", "date", "status", "title", "n_links", "payload_digest", "metadata", "text"]
    schema = ", ".join([f"`{c}` {responses.schema[c].dataType.simpleString()}" for c in keep] + [_RECORD])
    kinds = [pa.string()] * 5 + [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = []
                for m, c, r, u, d, status, title, links, payload, meta, text in zip(*(part.column(len(keep) + j).to_pylist() for j in range(len(used))), strict=True):
                    for kind, own, form, block in (("metadata", m, "application/json", meta.encode("utf-8", "replace")), ("conversion", c, "text/plain", text.encode("utf-8", "replace"))):
                        rows.append((kind, own, r, u, d, status, title, links, payload, digest(block), len(block), serialize(kind, own, u, d, r, form, block)))
                own = pa.array([j for j in range(part.num_rows) for _ in range(2)], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(j).take(own) for j in range(len(keep))), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], [*keep, *made])

    return derived.select(*keep, *[F.col(c).alias(f"_{c}") for c in used]).mapInArrow(run, schema)


def _members(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of a WARC file's bytes, decompressed one after another."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + step] for i in range(0, len(data), step))
        return
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        d, fed = zlib.decompressobj(31), at
        while not d.eof and fed < len(data):
            out = d.decompress(d.unconsumed_tail or data[fed : fed + 65536], step)
            if not d.unconsumed_tail:
                fed += 65536
            while out:
                yield out
                out = d.decompress(d.unconsumed_tail, step) if d.unconsumed_tail else b""
        at = min(fed, len(data)) - len(d.unused_data)
        if not d.eof:
            return


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers in order, block) of each record of a WARC file, compressed or not; one record is held at a time."""
    raw, more = bytearray(), _members(data)
    ended = False

    def fill(n: int) -> None:
        nonlocal ended
        while len(raw) < n and not ended:
            got = next(more, None)
            ended = got is None
            raw.extend(got or b"")

    while True:
        while (at := raw.find(b"WARC/1.")) < 0 and not ended:
            del raw[: max(0, len(raw) - 6)]
            fill(len(raw) + 1)
        if at < 0:
            return
        del raw[:at]
        while (stop := raw.find(b"\r\n\r\n")) < 0 and not ended:
            fill(len(raw) + 1)
        if stop < 0:
            return
        head = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in bytes(raw[:stop]).decode("utf-8", "replace").split("\r\n")[1:])]
        length = next((v for k, v in head if k.lower() == "content-length"), "0")
        n = int(length) if length.isdigit() else 0
        fill(stop + 4 + n)
        yield head, bytes(raw[stop + 4 : stop + 4 + n])
        del raw[: stop + 4 + n]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files, in the form that :func:`derive` takes."""
    files = spark.read.format("binaryFile").load(path).select("content")
    header = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    kind = pa.schema([("record_id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("headers", header), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

        for b in batches:
            for data in b.column(0):
                rows, size = [], 0
                for h, x in parse(data.as_py()):
                    first = {k.lower(): v for k, v in reversed(h)}
                    if first.get("warc-type") == "response":
                        rows.append((first.get("warc-record-id"), first.get("warc-target-uri"), first.get("warc-date"), [{"name": k, "value": v} for k, v in h], x))
                        size += len(x)
                        if size > 1 << 22:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(run, "record_id string, uri string, date string, headers array<struct<name:string,value:string>>, block binary")


def op3(spark, sf_dir: str) -> DataFrame:
    return records(responses_of(spark.read.parquet(f"{sf_dir}/pages.parquet")), keep=["page_id"])
