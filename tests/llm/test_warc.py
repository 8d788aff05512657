"""Archives: round trips and revisits against a plain computation."""

import base64
import gzip
import hashlib
import random
import zlib

import pytest

from vqspark.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, size int, record_type string"


def rows():
    body = "<html>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</html>"
    return [(5, "http://a/", body), (3, "http://b/\r\nX: y", body), (9, None, body), (1, "http://c/", None), (2, "http://d/", ""), (7, "http://e/", "x" * 2_000_000), (8, "http://e/", "x" * 2_000_000), (4, "http://f/", "alone"), (3, "http://b/", body), (None, "http://g/", body), (None, "http://g/", "odd")]


def want(pages, least=0):
    out, seen = [], set()
    for d, _, h in pages:
        h = h or ""
        raw = h.encode()
        first = min((x for x, _, y in pages if (y or "") == h and x is not None), default=None)
        again = len(raw) >= least and first is not None and (d != first or h in seen)
        if d == first:
            seen.add(h)  # a row that repeats the original's id revisits it
        out.append((d, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame([(d, u, h, "x", 1, "y") for d, u, h in rows()], SCHEMA)
    for least in (0, 3):
        found = warc.archive_round_trip(pages, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert sorted((tuple(r) for r in found.collect()), key=str) == want(rows(), least)


def test_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(d, u, h, "x", 1, "y") for d, u, h in rows()], SCHEMA)
    warc.write_archive(pages, str(tmp_path / "a"))
    found = warc.read_archive(spark, str(tmp_path / "a"), with_payload=True)
    assert sorted(((r.page_id, bytes(r.payload)) for r in found.collect()), key=str) == sorted(((d, (h or "").encode()) for d, _, h in rows()), key=str)


def test_empty(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_files_of_several_members():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    found = list(warc.records_of(gzip.compress(record) + gzip.compress(record * 2)))
    assert [b for _, b in found] == [b"hello"] * 3


def test_files_are_bounded_and_records_have_names_of_their_own(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}", "tiny" if i % 3 else f"tiny {i}") for i in range(3000)]
    rows += [(5000 + i, f"http://y/{i}", "".join(rng.choices("abcdefgh <>", k=90_000))) for i in range(60)]
    rows += [(7, "http://x/again", "tiny"), (1, "http://x/first", "tiny")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    path = tmp_path / "a"
    warc.write_archive(pages, str(path), file_bytes=400_000)
    files = sorted(path.glob("*.warc.gz"))
    assert len(files) > 10
    names, members = [], 0
    for file in files:
        data = file.read_bytes()
        found = list(warc.records_of(data))
        assert found[0][0]["WARC-Type"] == "warcinfo" and found[0][0]["WARC-Filename"] == file.name
        assert sum(len(b) for _, b in found) < 2 * 400_000
        names += [h["WARC-Record-ID"] for h, _ in found]
        at = 0
        while data[at:]:  # each member is one record
            engine = zlib.decompressobj(31)
            assert engine.decompress(data[at:]).startswith(b"WARC/1.1")
            at = len(data) - len(engine.unused_data)
            members += 1
    assert len(set(names)) == len(names) == members == len(rows) + len(files)
    (path / "part-000000-999999-0000.warc.gz").write_bytes(b"left by a task that was lost")
    found = warc.archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    got = sorted((tuple(r) for r in found), key=str)
    assert [(r[0], r[1], r[2], r[4]) for r in got if r[0] not in (1, 7)] == [(r[0], r[1], r[2], r[4]) for r in want(rows) if r[0] not in (1, 7)]
    assert sum(r[3] == "response" for r in got) == len({h for *_, h in rows})


def test_what_lost_tasks_leave_is_removed(spark, tmp_path):
    path = tmp_path / "b"
    path.mkdir()
    (path / "part-000000-999999-0000.warc.gz").write_bytes(b"left by a task that was lost")
    warc.write_archive(spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string"), str(path))
    assert [r.page_id for r in warc.read_archive(spark, str(path)).collect()] == [1]


def test_archives_that_are_cut_short():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 70000\r\n\r\n" + random.Random(2).randbytes(70_000) + b"\r\n\r\n"
    data = b"".join(gzip.compress(record) for _ in range(3))
    assert len(list(warc.records_of(data))) == 3 and not list(warc.records_of(b""))
    for size in (1, 500, len(data) // 2, len(data) - 1):
        with pytest.raises((ValueError, KeyError)):
            list(warc.records_of(data[:size]))
