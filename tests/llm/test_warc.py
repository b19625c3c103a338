import hashlib

import pytest
from codequarry.llm import warc as A
from codequarry.scratch import Scratch


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, digest string, size int").repartition(3)


LONG = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 8
ROWS = [
    (5, "http://a/ b", LONG), (2, "http://b", LONG), (9, None, LONG), (1, "http://c", "tiny"), (3, "http://d", "tiny"), (4, "http://e", None), (6, "http://f", ""),
    (7, "http://g", "x" * 300_000), (8, "http://h", "z" * 99), (10, "http://i", "z" * 99), (11, "http://j", "y" * 100), (12, "http://k", "y" * 100), (None, "http://l", LONG),
]


def expected(rows):
    least = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            least[h] = min(i, least.get(h, i))
    out = set()
    for i, _, h in rows:
        data = (h or "").encode()
        again = i is not None and len(data) >= 100 and least[h] != i
        out.add((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least[h] if again else None))
    return out


def test_round_trip(spark):
    got = A.round_trip(pages(spark, ROWS)).collect()
    assert len(got) == len(ROWS) and {tuple(r)[:5] for r in got} == expected(ROWS)
    assert len({r.record_id for r in got}) == len(got)
    assert {r.target_uri for r in got if r.page_id in (5, 9)} == {"http://a/%20b", "-"}
    assert A.round_trip(pages(spark, [])).collect() == []


def test_repeated_rows(spark):
    got = A.round_trip(pages(spark, [(1, "u", LONG), (1, "u", LONG), (2, "u", LONG), (2, "u", LONG)])).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response")] * 2 + [(2, "revisit")] * 2


def test_files_are_warc(spark):
    scratch = Scratch(spark, "t")
    A.write_archives(pages(spark, ROWS), f"{scratch.root}/a", scratch)
    records = [r for f in spark.read.format("binaryFile").load(f"{scratch.root}/a").collect() for r in A.parse_warc(bytes(f.content))]
    info = [h for h, _ in records if h["WARC-Type"] == "warcinfo"]
    assert len(records) - len(info) == len(ROWS) and info and len({h["WARC-Record-ID"] for h, _ in records}) == len(records)
    by = {h["X-Page-ID"]: (h, b) for h, b in records if "X-Page-ID" in h}
    web, _, empty = by["5"][1].partition(b"\r\n\r\n")
    assert by["5"][0]["WARC-Type"] == "revisit" and web.startswith(b"HTTP/1.1 200 OK\r\n") and empty == b"" and by["5"][0]["X-Refers-To-Page"] == "2"
    assert by["5"][0]["WARC-Refers-To"] == by["2"][0]["WARC-Record-ID"] and by["5"][0]["WARC-Refers-To-Target-URI"] == "http://b"
    assert by["2"][1].partition(b"\r\n\r\n")[2] == LONG.encode() and by["2"][0]["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(LONG.encode()).hexdigest()
    assert by["7"][0]["WARC-Date"] == "2000-01-01T00:00:00Z" and by["7"][0]["WARC-Record-ID"].startswith("<urn:uuid:")


@pytest.mark.parametrize("version", [1, 2])
def test_arc_is_parsed_by_its_declared_lengths(version):
    bodies = [b"", b"\n\n", b"http://x 1.2.3.4 20000101000000 text/html 5\nhello", "é".encode() * 50]
    data = A.version_block(version) + b"".join(A.arc_record(version, f"http://h/{k}", b) for k, b in enumerate(bodies))
    got = list(A.parse_arc(data))
    assert [b for _, b in got] == bodies and [h["url"] for h, _ in got] == [f"http://h/{k}" for k in range(4)]
    assert ("result" in got[0][0]) == (version == 2)
    with pytest.raises(ValueError):
        list(A.parse_arc(data[:-20]))
    with pytest.raises(ValueError):
        list(A.parse_arc(A.version_block(version) + b"only three fields\n"))


def test_files_are_bounded_in_bytes(spark, monkeypatch):
    scratch = Scratch(spark, "t")
    rows = [(i, f"http://h/{i}", "x" * 900 + str(i)) for i in range(700)]
    monkeypatch.setattr(A, "FILE_BYTES", 200_000)
    # the setting is read by the workers, so the batches are called here
    import pyarrow as pa

    n = len(rows)
    columns = {"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": [r[2] for r in rows], "digest": [hashlib.sha256(r[2].encode()).hexdigest() for r in rows], "kind": ["response"] * n, "refers_to": [None] * n, "first_url": [None] * n}
    files = [b.column("value")[0].as_py() for b in A._convert(iter([pa.RecordBatch.from_pydict(columns)]))]
    assert len(files) > 3 and all(len(f) < 320_000 for f in files)
    got = [h for f in files for h, _ in A.parse_warc(f.encode() + A.END.encode())]
    assert sum(h["WARC-Type"] == "response" for h in got) == n and sum(h["WARC-Type"] == "warcinfo" for h in got) == len(files)


def test_stored_arcs_are_read_with_their_defects(spark, tmp_path):
    import gzip

    web = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n<p>hi</p>"
    good = [A.arc_record(2, f"http://h/{k}", b, date=d) for k, (b, d) in enumerate([(web, "20010203040506"), (b"plain", "199912312359"), (b"\xff\xfe", "20010203040506")])]
    (tmp_path / "two.arc").write_bytes(A.version_block(2) + b"".join(good))
    one = [A.arc_record(1, f"http://g/{k}", b"body %d" % k) for k in range(3)]
    blank = b"http://g/a b c 1.2.3.4 20010101000000 text/html 4\nabcd\n"
    bad = b"http://g/x 1.2.3.4 20010101000000 text/html many\nlost\n" + A.arc_record(1, "http://g/after", b"again") + b"only three fields\n" + A.arc_record(1, "http://g/late", b"late") + b"http://g/y 1.2.3.4 yesterday text/html 2\nzz\nhttp://g/cut 1.2.3.4 20010101000000 text/html 999\nshort"
    data = A.version_block(1) + b"".join(one) + blank + bad
    (tmp_path / "one.arc.gz").write_bytes(gzip.compress(data[:200]) + gzip.compress(data[200:]))
    (tmp_path / "torn.arc.gz").write_bytes(gzip.compress(A.version_block(1) + one[0]) + gzip.compress(one[1])[:-12])
    (tmp_path / "none.arc").write_bytes(b"")
    rows = {(r.file.rpartition("/")[2], r.place): r for r in A.read_arcs(spark, str(tmp_path)).collect()}
    two = [rows["two.arc", k] for k in range(3)]
    assert [bytes(r.payload) for r in two] == [b"<p>hi</p>", b"plain", b"\xff\xfe"] and two[0].http_head.startswith("HTTP/1.0 200") and two[0].result == "200"
    assert A.warc_date(two[1].date) == "1999-12-31T23:59:00Z"
    first = [rows["one.arc.gz", k] for k in range(10)]
    assert [(r.url, r.defect) for r in first[3:]] == [
        ("http://g/a b c", None), ("http://g/x", "length"), ("http://g/after", None), ("only three fields", "fields"), ("http://g/late", None), ("http://g/y", "date"), ("http://g/cut", "length"),
    ]
    assert bytes(first[3].payload) == b"abcd" and bytes(first[5].payload) == b"again" and bytes(first[7].payload) == b"late"
    assert [rows["torn.arc.gz", k].defect for k in range(3)] == [None, "length", "gzip"] and not any(f == "none.arc" for f, _ in rows)
    pages_ = A.arcs_as_pages(A.read_arcs(spark, str(tmp_path)))
    back = A.round_trip(pages_).collect()
    assert len(back) == sum(r.defect is None for r in rows.values()) - 1 and {"http://h/0", "http://g/a%20b%20c"} <= {r.target_uri for r in back}
