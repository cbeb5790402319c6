"""Archives as crawlers leave them: a gzip member a record, any name, plain or packed; and secrets in very long texts."""

import gzip
import random
import time
import zlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from lumenvec.llm import secret_scans, warc  # noqa: E402
from lumenvec.llm.queries import BYTE_BPE  # noqa: E402


def arc_records(version, bodies, date="20040506070809"):
    info = f"{version} 0 crawler\n{' '.join(warc.FIELDS[version])}\n".encode()
    middle = "" if version == 1 else " 200 abc - 77 f.arc"
    out = [f"filedesc://f 0.0.0.0 {date} text/plain{middle} {len(info)}\n".encode() + info + b"\n"]
    for k, body in enumerate(bodies):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
        out.append(f"http://a/{k} 1.2.3.4 {date} text/html{middle} {len(block)}\n".encode() + block + b"\n")
    return out


BODIES = [b"one", b"", bytes(range(256)) * 3000, b"two\n\nfiledesc://x 1 2 3\n", "é".encode() * 2000]


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("layout", ["member a record", "one member", "plain", "padded", "members cut anywhere"])
def test_layouts(version, layout):
    records = arc_records(version, BODIES)
    whole = b"".join(records)
    data = {
        "member a record": b"".join(map(gzip.compress, records)), "one member": gzip.compress(whole), "plain": whole, "padded": b"".join(map(gzip.compress, records)) + b"\0" * 600,
        "members cut anywhere": b"".join(gzip.compress(whole[k : k + 70_001]) for k in range(0, len(whole), 70_001)),
    }[layout]
    got = list(warc.parse_arc(data))
    assert [warc.split_http(r["block"])[1] for r in got] == BODIES
    assert [r["offset"] for r in got] == [sum(map(len, records[: k + 1])) for k in range(len(BODIES))]
    for cut in (data[:-700], data[: len(data) // 2]):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.parse_arc(cut))


def test_many_members_take_linear_time():
    records = arc_records(1, [b"x" * 50] * 40_000)
    data = b"".join(map(gzip.compress, records))
    began = time.perf_counter()
    assert sum(1 for _ in warc.parse_arc(data)) == 40_000 and time.perf_counter() - began < 20


def test_foreign_archives_are_converted(spark, tmp_path):
    """Names of any kind in two folders that hold files of one name; equal payloads are still told apart by their records."""
    big = b"q" * 1500
    for folder, version in (("a", 1), ("b", 2)):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "crawl-2004.arc.gz").write_bytes(b"".join(map(gzip.compress, arc_records(version, [big, b"small", bytes(range(256))]))))
    (tmp_path / "in" / "b" / "old.arc").write_bytes(b"".join(arc_records(1, [big], "1998")))
    warc.convert_arc(spark, str(tmp_path / "in/*"), str(tmp_path / "out"))
    got = warc.read_warc(spark, str(tmp_path / "out")).collect()
    assert len(got) == 7 and len({r.record_id for r in got}) == 7
    same = [r for r in got if r.payload_bytes == 1500]
    first = [r for r in same if r.record_type == "response"]
    assert len(same) == 3 and len(first) == 1 and {r.refers_to_id for r in same if r.record_type == "revisit"} == {first[0].record_id}
    assert {r.date for r in got} == {"2004-05-06T07:08:09Z", "1998-01-01T00:00:00Z"} and {r.url for r in got} == {"http://a/0", "http://a/1", "http://a/2"}
    # every record can be read from its own member
    for f in (tmp_path / "out").glob("part-*"):
        data, found = f.read_bytes(), 0
        while data:
            unpack = zlib.decompressobj(31)
            record = unpack.decompress(data)
            data = unpack.unused_data
            found += bool(record)
            assert record in (b"",) or (record.startswith(b"WARC/1.1\r\n") and len(list(warc.parse_warc(record))) == 1)
        assert found
    assert warc.read_warc(spark, str(tmp_path / "out"), names="no*").count() == 0


def test_dates():
    assert [warc.warc_date(d) for d in ("1998", "199807", "19980704", "1998070412", "199807041259", "19980704125958")] == ["1998-01-01T00:00:00Z", "1998-07-01T00:00:00Z", "1998-07-04T00:00:00Z", "1998-07-04T12:00:00Z", "1998-07-04T12:59:00Z", "1998-07-04T12:59:58Z"]
    for bad in ("", "98", "2004-05-06", "200405060708091"):
        with pytest.raises(ValueError):
            warc.warc_date(bad)


def test_secrets_in_long_and_odd_texts(spark):
    random.seed(4)
    log = "\n".join(f"{k} {random.randbytes(32).hex()}" for k in range(60_000))  # 4 MB of digests
    encoding = secret_scans._encoding(*BYTE_BPE[1:])
    began = time.perf_counter()
    base, more = secret_scans.spans_of(log, encoding)
    assert len(base) == 60_000 and not more and time.perf_counter() - began < 10
    docs = spark.createDataFrame([(1, "token=abcdef1"), (1, "token=abcdef1"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_assign, r.spans) for r in secret_scans.scan(docs, *BYTE_BPE[1:]).collect())
    assert got == [(1, 1, "assign:0:13"), (1, 1, "assign:0:13"), (2, 0, "")]
    assert secret_scans.scan(docs.limit(0), *BYTE_BPE[1:]).count() == 0


def test_random_spans_touch_no_base_span():
    """The walk along both lists against a comparison of all with all."""
    encoding = secret_scans._encoding(*BYTE_BPE[1:])
    random.seed(6)
    draw = lambda: random.choice(["token=", " ", "AKIA" + "A" * 18, random.randbytes(14).hex(), "".join(random.choices("ABCDEFabcdefghij0123456789", k=30)), ".", "/", "é", "\n"])
    for _ in range(200):
        text = "".join(draw() for _ in range(30))
        base, more = secret_scans.spans_of(text, encoding)
        want = []
        for m in secret_scans.RUN.finditer(text):
            if not any(s < m.end() and m.start() < e for s, _, e in base):
                want += secret_scans._random_spans(text, m.start(), m.end(), encoding)
        assert more == want
