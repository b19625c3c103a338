"""Legacy archives to WARC: ARC records are parsed by their declared lengths and
version-specific header lines, and written as equivalent WARC records.

ARC version 1 record lines hold URL, IP, date, type and length; version 2 lines
add result code, checksum, location, offset and file name.  The WARC record
gets an identifier (derived from date, URL and digest, so a rerun writes the
same one), an ISO timestamp, a type, an HTTP head where the ARC record had none,
and SHA-256 digests of block and payload.  Records of equal, large enough
payloads are revisits of the first and refer to its identifier.  Each file opens
with a warcinfo record made of the ARC's version block.

Stored ARC files, plain or gzipped by member, are read by ``read_arcs``: what
does not parse is a row with its defect, not a failure.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codequarry.llm.docfilter import prefilter, without
from codequarry.scratch import Scratch

V1_FIELDS = ("url", "ip", "date", "type", "length")
V2_FIELDS = ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length")
EPOCH = "20000101000000"
LEAST_REVISIT = 100
#: Bytes of an archive file, about (one record is the least); an archive is
#: read by one task.
FILE_BYTES = 8 << 20
INFO = "software: codequarry\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC versions 1 and 2\r\n"
END = "\r\n\r\n"


def arc_record(version: int, url: str, payload: bytes, date: str = EPOCH, mime: str = "text/html", ip: str = "0.0.0.0", offset: int = 0, filename: str = "pages.arc") -> bytes:
    """One ARC record: header line, body of the declared length, newline."""
    head = [quote(url) or "-", ip, date, mime]
    if version == 2:
        head += ["200", "-", "-", str(offset), filename]
    return (" ".join([*head, str(len(payload))]) + "\n").encode() + payload + b"\n"


def quote(url: str | None) -> str:
    """Blanks and controls of a URL as %XX, so that a header line stays one."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def version_block(version: int) -> bytes:
    """The record that opens an ARC file and names its version and fields."""
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    body = f"{version} 0 codequarry\n{names}\n".encode()
    tail = "" if version == 1 else " 200 - - 0 pages.arc"
    return f"filedesc://pages.arc 0.0.0.0 {EPOCH} text/plain{tail} {len(body)}\n".encode() + body + b"\n"


#: A line that can only be a record header: where to go on after a defect.
HEADER = re.compile(rb"\n([^\s:]+:[^\n]* \d{1,3}(?:\.\d{1,3}){3} \d{12,14} [^\n]* \d+)\r?\n")


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(header fields, payload, defect) of each record after the version block.

    The body is cut by its declared length, never searched for an end mark.  The
    fields are counted from the right, as a URL may hold blanks.  Defects:
    ``version`` (the first line is none of a version block: version 1 is taken),
    ``fields`` (too few), ``length`` (no number, or beyond the data), ``date``
    (not 12 or 14 digits).  After a lost length the next line that can only be a
    header is looked for.
    """
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        stop = data.find(b"\n", at)
        stop = len(data) if stop < 0 else stop
        line = data[at:stop].decode("utf-8", "replace").rstrip("\r")
        if fields is None:
            last = line.rsplit(" ", 1)[-1]
            fields = V1_FIELDS
            if line.startswith("filedesc:") and last.isdigit():
                body = data[stop + 1 : stop + 1 + int(last)]
                fields = V2_FIELDS if body[:1] == b"2" else V1_FIELDS
                at = stop + 1 + int(last)
                continue
            yield {"url": line}, b"", "version"
        parts = line.rsplit(" ", len(fields) - 1)
        head = dict(zip(fields, parts)) if len(parts) == len(fields) else {"url": line}
        defect = "fields" if "length" not in head else None if head["length"].isdigit() else "length"
        end = stop + 1 + int(head["length"]) if defect is None else stop
        if defect is None and end > len(data):
            defect, end = "length", stop
        if defect is not None:
            yield head, b"", defect
            again = HEADER.search(data, min(end, len(data)))
            at = again.start(1) if again else len(data)
            continue
        if not (head["date"].isdigit() and len(head["date"]) in (12, 14)):
            defect = "date"
        yield head, data[stop + 1 : end], defect
        at = end


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of each record; ValueError at the first defect."""
    for head, payload, defect in arc_records(data):
        if defect is not None:
            raise ValueError(f"ARC record with a defect of its {defect}")
        yield head, payload


def inflated(data: bytes) -> tuple[bytes, bool]:
    """The content of a file of gzip members (or of a plain file), and whether
    all of it could be read."""
    if data[:2] != b"\x1f\x8b":
        return data, True
    out, rest = [], data
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(rest) + member.flush())
        except zlib.error:
            return b"".join(out), False
        if not member.eof:
            return b"".join(out), False
        rest = member.unused_data
    return b"".join(out), not rest.strip(b"\0")


def _arc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "place", "url", "ip", "date", "mime", "result", "http_head", "payload", "defect"]
    types = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.binary(), pa.string()]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data, whole = inflated(content.as_py())
            rows, size, place = [], 0, -1
            for place, (head, payload, defect) in enumerate(arc_records(data)):
                web, body = b"", payload
                if payload.startswith(b"HTTP/") and b"\r\n\r\n" in payload:
                    web, _, body = payload.partition(b"\r\n\r\n")
                rows.append((file, place, head.get("url"), head.get("ip"), head.get("date"), head.get("type"), head.get("result"), web.decode("latin-1") or None, body, defect))
                size += len(payload)
                if size > FILE_BYTES:
                    yield flush(rows)
                    rows, size = [], 0
            if not whole:
                rows.append((file, place + 1, *[None] * 6, b"", "gzip"))
            if rows:
                yield flush(rows)


def read_arcs(spark, path: str) -> DataFrame:
    """One row for each record of the ARC files below ``path``, gzipped or not.

    Columns: file, place (in the file), url, ip, date, mime, result (version 2),
    http_head (null without one), payload (what follows it) and defect: null, or
    what is wrong (see ``arc_records``; ``gzip``: the rest cannot be inflated).
    A row with a ``date`` defect has its payload, one with another has none.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_arc_rows, "file string, place bigint, url string, ip string, date string, mime string, result string, http_head string, payload binary, defect string")


def warc_date(date: str) -> str:
    """ISO time of an ARC date; one of 12 digits has no seconds."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(page_id: int | None, url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{date}|{digest}')}>"


def warc_head(head: dict[str, str], digest: str, size: int, kind: str, page_id: int | None, refers_to: int | None, first_url: str | None = None) -> dict[str, str]:
    """The WARC header fields that an ARC header and a payload give."""
    out = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(page_id, head["url"], head["date"], digest),
        "WARC-Date": warc_date(head["date"]),
        "WARC-Target-URI": head["url"],
        "WARC-IP-Address": head["ip"],
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(size),
    }
    if kind == "revisit":
        first = quote(first_url) or "-"
        out |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, first, head["date"], digest),
            "WARC-Refers-To-Target-URI": first, "WARC-Refers-To-Date": warc_date(head["date"]), "X-Refers-To-Page": str(refers_to),
        }
    return out


def warc_text(head: dict[str, str], block: str) -> str:
    """A record without its closing two line ends (the writer adds them)."""
    data = block.encode()
    fields = head | {"WARC-Block-Digest": f"sha256:{hashlib.sha256(data).hexdigest()}", "Content-Type": head.get("Content-Type", "application/http; msgtype=response"), "Content-Length": str(len(data))}
    return "WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in fields.items()) + END + block


def http_head(mime: str, size: int) -> str:
    """The head of a response whose own was not kept."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\nContent-Length: {size}{END}"


def info_text(name: str) -> str:
    """The warcinfo record that opens a file."""
    return warc_text({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(None, name, EPOCH, "warcinfo"), "WARC-Date": warc_date(EPOCH), "Content-Type": "application/warc-fields"}, INFO)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, cut by Content-Length."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("no WARC record at this place")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        body = stop + 4
        end = body + int(head["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError("WARC record without its end")
        yield head, data[body:end]
        at = end + 4


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows -> ARC bytes -> parsed records -> texts of whole WARC files."""
    out, size = [], 0

    def flush() -> pa.RecordBatch:
        name = hashlib.sha256("".join(out).encode()).hexdigest()
        return pa.RecordBatch.from_arrays([pa.array([END.join([info_text(name), *out])], pa.string())], ["value"])

    for batch in batches:
        ids, urls, pages = (batch.column(c).to_pylist() for c in ("page_id", "url", "html"))
        kinds, refers, mine, firsts = (batch.column(c).to_pylist() for c in ("kind", "refers_to", "digest", "first_url"))
        for at in range(0, len(ids), 64):
            part = range(at, min(at + 64, len(ids)))
            # both versions of the format pass through the same parser
            rows = {v: [i for i in part if (i % 2) + 1 == v] for v in (1, 2)}
            for version, own in rows.items():
                arc = version_block(version) + b"".join(arc_record(version, urls[i], (pages[i] or "").encode()) for i in own)
                for i, (head, payload) in zip(own, parse_arc(arc), strict=True):
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest != mine[i]:
                        raise ValueError(f"payload of page {ids[i]} changed on its way")
                    block = "" if kinds[i] == "revisit" else payload.decode()
                    fields = warc_head(head, digest, len(payload), kinds[i], ids[i], refers[i], firsts[i])
                    out.append(warc_text(fields, http_head(head["type"], len(payload)) + block))
                    size += len(out[-1])
            if size > FILE_BYTES:
                yield flush()
                out.clear()
                size = 0
    if out:
        yield flush()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archive files -> one row per record, digests of blocks and payloads recomputed."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id", "target_uri", "warc_date"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4]
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for head, block in parse_warc(content.as_py()):
                if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:"):
                    raise ValueError(f"bad block digest in record {head['WARC-Record-ID']}")
                if head["WARC-Type"] == "warcinfo":
                    continue
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                if head["WARC-Type"] == "response" and hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest() != digest:
                    raise ValueError(f"bad digest in record {head['WARC-Record-ID']}")
                page, refers = head["X-Page-ID"], head.get("X-Refers-To-Page")
                rows.append((int(page) if page else None, int(head["X-Payload-Length"]), digest, head["WARC-Type"], int(refers) if refers else None, head["WARC-Record-ID"], head.get("WARC-Refers-To"), head["WARC-Target-URI"], head["WARC-Date"]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def write_archives(pages: DataFrame, path: str, scratch: Scratch) -> None:
    """Convert ``pages`` and write WARC files below ``path``.

    Files are plain WARC of about ``FILE_BYTES`` at most, so each is read by one
    task in bounded memory (one record is the least).
    """
    text = F.coalesce("html", F.lit(""))
    facts = [F.sha2(F.encode(text, "utf-8"), 256).alias("digest"), F.octet_length(text).alias("size")]
    long = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", *facts).where(F.col("page_id").isNotNull() & (F.col("size") >= LEAST_REVISIT)).select("page_id", "url", "digest")
    # only digests, ids and urls are shuffled, first the least ids, which are
    # written: the join can then split the pages of a payload that very many have
    first = long.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("one"), F.count("*").alias("n")).where("n > 1")
    first = scratch.save(first.select("digest", F.col("one.page_id").alias("first"), F.col("one.url").alias("first_url")), "first")
    revisits = scratch.save(long.select("page_id", "digest").join(first, "digest").where("page_id <> first").distinct(), "revisits")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    ids = revisits.select("page_id")
    null = F.lit(None)
    plain = without(rows, ids, "page_id").select("*", facts[0], F.lit("response").alias("kind"), null.cast("bigint").alias("refers_to"), null.cast("string").alias("first_url"))
    other = prefilter(rows, ids, "page_id").select("*", facts[0]).join(revisits, ["page_id", "digest"], "left")
    other = other.select("page_id", "url", "html", "digest", F.when(F.col("first").isNotNull(), "revisit").otherwise("response").alias("kind"), F.col("first").alias("refers_to"), "first_url")
    # a row is a file
    plain.union(other).mapInArrow(_convert, "value string").write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """One row for each page's record of the WARC files below ``path``."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, refers_to_id string, target_uri string, warc_date string"
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, schema)


def arcs_as_pages(arcs: DataFrame) -> DataFrame:
    """Sound records of ``read_arcs`` as pages for ``write_archives``.

    The id is a hash of file and place.  Payloads that are no UTF-8 are left to
    the reader's rows: the text sink cannot hold them.
    """
    text = F.decode("payload", "utf-8")
    sound = arcs.where(F.col("defect").isNull() & F.expr("is_valid_utf8(cast(payload as string))"))
    return sound.select(F.xxhash64("file", "place").alias("page_id"), "url", text.alias("html"))


def round_trip(pages: DataFrame, label: str = "warc") -> DataFrame:
    """Write every page to WARC archives and read them back.

    Needs ``page_id``, ``url`` and ``html``; other columns are not read.
    Result per page: page_id, payload_bytes, payload_digest, record_type,
    refers_to, record_id, refers_to_id (of the response's record), target_uri,
    warc_date.  A null html is an empty
    payload, a null url is written as ``-``.  Of equal payloads of at least
    100 bytes the least page_id is the response, the others are revisits of
    it; smaller payloads are responses all.  Rows without page_id are
    responses.  A repeated row of the least page_id is a response too.
    """
    scratch = Scratch(pages.sparkSession, label)
    path = f"{scratch.root}/archives"
    write_archives(pages, path, scratch)
    return read_archives(pages.sparkSession, path)
