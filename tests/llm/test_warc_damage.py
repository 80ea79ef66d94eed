"""Damaged archives: what can be read is read, the rest is told."""

import gzip
import io

from kerbline.llm import warc


def arc(*records):
    return warc.arc_filedesc(1, "x") + b"\n" + b"\n".join(records) + b"\n"


def page(i, payload=b"<p>text</p>"):
    return warc.arc_record(1, "x", i, f"http://example.net/{i}", payload)


def overlong(record):
    line, _, rest = record.partition(b"\n")
    return line.rpartition(b" ")[0] + b" 999999\n" + rest


def read(data, parse=warc.parse_arc):
    found = list(parse(io.BufferedReader(warc.Inflated(data))))
    return [r["page_id"] for r in found if not r.get("reason")], [r["reason"] for r in found if r.get("reason")]


def test_records_after_an_overlong_length_are_read():
    assert read(gzip.compress(arc(page(1), overlong(page(2)), page(3), overlong(page(4)), page(5)))) == ([1, 3, 5], ["shorter than declared"] * 2)


def test_members_and_short_reads_join():
    whole = arc(page(1, b"x" * 300_000), page(2))
    parts = b"".join(gzip.compress(whole[i : i + 1000]) for i in range(0, len(whole), 1000))
    raw = warc.Inflated(parts)
    assert io.BufferedReader(raw).read() == whole and raw.broken is None
    assert read(parts) == ([1, 2], [])


def test_a_cut_file_gives_its_whole_records(spark, tmp_path):
    data = gzip.compress(arc(*(page(i, bytes(range(256)) * 40 + str(i).encode() * 500) for i in range(20))))
    (tmp_path / "a.arc.gz").write_bytes(data[: len(data) * 2 // 3])
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(arc(page(100))) + b"no gzip at all")
    (tmp_path / "c.arc.gz").write_bytes(b"")
    got = sorted(r.page_id for r in warc.read_arc(spark, str(tmp_path)).collect())
    assert got[-1] == 100 and got[:-1] == list(range(len(got) - 1)) and 1 < len(got) < 20
    assert {(r.file, r.reason) for r in warc.read_rejected(spark, str(tmp_path)).collect()} >= {("a.arc.gz", "cut off"), ("b.arc.gz", "no gzip")}


def test_bad_warc_records_are_rejected(spark, tmp_path):
    import hashlib

    def record(i, payload, said=None):
        digest = said or hashlib.sha256(payload).hexdigest()
        return warc.warc_record(f"http://a/{i}", "0.0.0.0", warc.DATE, b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\n\r\n" % i, payload, digest, "f", i, None) + b"\r\n\r\n"

    parts = [record(1, b"one"), record(2, b"two", "0" * 64), b"WARC/1.1\r\nWARC-Type: response\r\n\r\njunk\r\n", record(3, b"three").replace(b"Content-Length: ", b"Content-Length: 9999"), record(4, b"four")]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    assert sorted(r.page_id for r in warc.read_warc(spark, str(tmp_path)).collect()) == [1, 4]
    assert sorted(r.reason for r in warc.read_warc_rejected(spark, str(tmp_path)).collect()) == ["fields missing", "other digest", "shorter than declared"]
