"""WARC derivatives: from every response record a metadata record and a plain-text conversion record that refer to it.

A response's HTTP block is parsed; its payload digest is checked against the header. The metadata record holds the source's
status, HTTP headers, title, charset, links and digest as warc-fields; the conversion record holds the visible text. Both keep
the target URI and date, carry WARC-Refers-To with the response's id, and have ids and digests of their own that follow from it.

Files are sequences of gzip members, one per record, in a folder that all executors reach. Every file of responses becomes one file
of derivatives, whose name follows from the other's path; a file appears under its name when it is whole, so a repeated task leaves
the same files however the paths are dealt.

Cases: null or empty html: a response with an empty body, an empty conversion; null url: target about:blank; null page_id: no
page id header; equal rows: equal record ids, each converted; a damaged gzip member: reading goes on at the next one; a damaged
record, one that is no response, or whose digest does not fit: not converted, counted in the manifest's column skipped, and a row
of type damaged in read_records() if it can't be read or its digest does not fit; derivatives() raises if any is skipped; empty
table: no files, empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import html as H

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 2_000
LEVEL = 3


# ---- records


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def _clean(value: str) -> str:
    return " ".join(value.split())


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *[f"{k}: {_clean(v)}".encode() for k, v in head], b"", block]) + b"\r\n\r\n"


def response(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> bytes:
    body = (html or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%s" % (len(body), body)
    url = url or "about:blank"
    own = [("X-Page-Id", str(page_id))] if page_id is not None else []
    return record([("WARC-Type", "response"), ("WARC-Record-ID", record_id(url, str(page_id))), ("WARC-Target-URI", url), ("WARC-Date", date), *own, ("WARC-Payload-Digest", digest(body)), ("Content-Type", "application/http; msgtype=response")], block)


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (lower-case names; the first of equal ones) and block, or None if the record is cut off or no record."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/"):
        return None
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers.setdefault(name.strip().lower(), value.strip())
    length = headers.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        return None
    return headers, rest[: int(length)]


def derive(raw: bytes) -> tuple[bytes, bytes] | None:
    """Metadata and conversion record of a response record; None for any other and for one whose digest does not fit."""
    got = parse(raw)
    if not got or got[0].get("warc-type", "").lower() != "response":
        return None
    source, block = got
    head, mark, body = block.partition(b"\r\n\r\n")
    claimed = source.get("warc-payload-digest")
    if not mark or (claimed and claimed != digest(body)):
        return None
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    http = [tuple(x.strip() for x in line.partition(":")[::2]) for line in lines]
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = kind.lower().partition("charset=")[2].split(";")[0].strip("\"' ") or "utf-8"
    try:
        page = body.decode(charset, "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    found, _ = H.blocks(page)
    text = "\n".join(b.text for b in found).encode()
    title = H.re.search(r"<title[^>]*>(.*?)(?:</title|\Z)", page, H.re.S | H.re.I)
    links = [H.html.unescape(a or b or c) for a, b, c in H.re.findall(r"""<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", page, H.re.I)]
    fields = [("http-status", status), *[(f"http-header-{k.lower()}", v) for k, v in http], ("charset", charset), ("title", H.html.unescape(title[1]) if title else ""), ("source-payload-digest", claimed or digest(body)), ("source-length", str(len(body))), ("links", str(len(links))), *[("outlink", x) for x in links]]
    rid = source.get("warc-record-id", "")
    shared = [("WARC-Refers-To", rid), ("WARC-Target-URI", source.get("warc-target-uri", "")), ("WARC-Date", source.get("warc-date", "")), *[("X-Page-Id", source[k]) for k in ("x-page-id",) if k in source], ("X-Source-Payload-Digest", claimed or digest(body))]
    about = "".join(f"{k}: {_clean(v)}\r\n" for k, v in fields).encode()
    return (
        record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(rid, "metadata")), *shared, ("Content-Type", "application/warc-fields")], about),
        record([("WARC-Type", "conversion"), ("WARC-Record-ID", record_id(rid, "conversion")), *shared, ("WARC-Payload-Digest", digest(text)), ("Content-Type", "text/plain; charset=utf-8")], text),
    )


# ---- files


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


MAGIC = b"\x1f\x8b\x08"


def members(stream, step: int = 1 << 17, lost: list | None = None):
    """Records of a file of gzip members, one at a time. A stretch that is damaged or cut off is passed over up to the next member; lost gets an entry for each."""
    whole, sound = b"", True  # what is read from the start of a member on

    def next_start() -> None:
        nonlocal whole, sound
        if sound and lost is not None:
            lost.append(len(whole))
        at = whole.find(MAGIC, 1)
        whole, sound = whole[at:] if at >= 0 else whole[max(1, len(whole) - len(MAGIC) + 1) :], False

    while True:
        if not whole:
            whole = stream.read(step)
            if not whole:
                return
        z, out, at = zlib.decompressobj(31), [], 0
        while not z.eof:
            try:
                out.append(z.decompress(whole[at:]))
            except zlib.error:
                next_start()
                break
            at = len(whole)
            if not z.eof:
                more = stream.read(step)
                if not more:  # cut off
                    next_start()
                    break
                whole += more
        else:
            whole, sound = z.unused_data, True
            yield b"".join(out)


class _File:
    """A file of records that appears under its name when it is closed."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        self.path, self.n, self.skipped = f"{folder}/{name}", 0, 0
        self.fs, at = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(at, recursive=True)
        self.at, self.own = f"{at}/{name}", f"{at}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own, compression=None)

    def put(self, *raws: bytes) -> None:
        for raw in raws:
            self.out.write(member(raw))
        self.n += 1

    def close(self) -> pa.RecordBatch:
        self.out.close()
        self.fs.move(self.own, self.at)
        return pa.RecordBatch.from_arrays([pa.array([self.path]), pa.array([self.n]), pa.array([self.skipped])], ["path", "n", "skipped"])


MANIFEST = "path string, n long, skipped long"


def _open(path: str):
    from pyarrow import fs

    at_fs, at = fs.FileSystem.from_uri(path)
    return at_fs.open_input_stream(at, compression=None)


def write_responses(pages: DataFrame, folder: str) -> DataFrame:
    """Manifest (path, n, skipped: 0) of files with one response per page."""

    def run(batches):
        file, part = None, 0
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = file or _File(folder, f"response-{TaskContext.get().partitionId():06d}-{part:04d}.warc.gz")
                file.put(response(page_id, url, html))
                if file.n >= RECORDS_PER_FILE:
                    yield file.close()
                    file, part = None, part + 1
        if file:
            yield file.close()

    return C.cut(pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, MANIFEST), "warc-manifest")


def _spread(manifest: DataFrame) -> DataFrame:
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n, "path").sortWithinPartitions("path")


def write_derivatives(manifest: DataFrame, folder: str) -> DataFrame:
    """Manifest (path, n: responses converted, skipped: other and damaged records) of one file for every file of a manifest (path)."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                file, lost = _File(folder, f"derived-{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}.warc.gz"), []
                with _open(path) as stream:
                    for raw in members(stream, lost=lost):
                        both = derive(raw)
                        if both:
                            file.put(*both)
                        else:
                            file.skipped += 1
                file.skipped += len(lost)
                yield file.close()

    return C.cut(_spread(manifest).mapInArrow(run, MANIFEST), "warc-derived")


SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, source_digest string, block_digest string, content_length long, n_chars long, n_lines long"


def read_records(manifest: DataFrame, with_block: bool = False) -> DataFrame:
    """One row per record in the files of a manifest; with_block: its block as text too. What can't be read, or whose digest does not fit, is a row of type damaged with nothing else."""

    damaged = (None, "damaged", *[None] * (10 + with_block))

    def row(raw: bytes):
        got = parse(raw)
        if not got or got[0].get("warc-block-digest") not in (None, digest(got[1])):
            return damaged
        h, block = got
        text = block.decode("utf-8", "replace")
        page = h.get("x-page-id")
        out = (int(page) if page else None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), h.get("x-source-payload-digest"), h.get("warc-block-digest"), len(block), len(text), text.count("\n") + bool(text and not text.endswith("\n")))
        return (*out, text) if with_block else out

    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["block"] * with_block
    kinds = {"page_id": pa.int64(), "content_length": pa.int64(), "n_chars": pa.int64(), "n_lines": pa.int64()}

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path) as stream:
                    held, lost = [], []
                    for raw in members(stream, lost=lost):
                        held.append(row(raw))
                        if len(held) >= 500:
                            yield batch_of(held)
                            held = []
                    held += [damaged] * len(lost)
                    if held:
                        yield batch_of(held)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    return _spread(manifest).mapInArrow(run, SCHEMA + ", block string" * with_block)


def derivatives(pages: DataFrame) -> DataFrame:
    """The pages as response files, their derivatives as files, and a row per derived record read back from them."""
    spark = pages.sparkSession
    made = write_derivatives(write_responses(pages, C.fresh_path(spark, "warc-responses")), C.fresh_path(spark, "warc-derived"))
    lost = made.where("skipped > 0").select("path").limit(1).collect()
    if lost:
        raise ValueError(f"records were skipped: {lost[0].path}")
    return read_records(made)
