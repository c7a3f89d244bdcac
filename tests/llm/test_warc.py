import hashlib
import io
import os
import zipfile

import pytest

from cartograph.llm.queries import op9_warc
from cartograph.llm.warc_zip import (
    INDEX_NAME, WARC_NAME, ZipRanges, archive_pages, entries_of, open_bytes, open_file, parse_record, read_archives, record_bytes, records_of,
    write_archives, zip_stored,
)


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_against_the_standard_library(zip64, tmp_path):
    members = [("a.txt", b"hello"), ("dir/b.bin", os.urandom(3000)), ("empty", b"")]
    raw = zip_stored(members, zip64)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
    mine = open_bytes(raw)
    assert {n: mine.read(n) for n in mine.members} == dict(members)
    assert mine.read("dir/b.bin", 10, 5) == members[1][1][10:15]
    with pytest.raises(ValueError):
        mine.read("a.txt", 3, 9)
    path = tmp_path / "x.zip"
    path.write_bytes(raw)
    assert open_file(str(path)).read("a.txt") == b"hello"


def test_foreign_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\x05\x06 a comment that looks like the end record"
        z.writestr("stored.txt", b"x" * 50)
        z.writestr("packed.txt", b"y" * 5000, compress_type=zipfile.ZIP_DEFLATED)
        with z.open(zipfile.ZipInfo("large"), "w", force_zip64=True) as f:
            f.write(b"z" * 10)
    mine = open_bytes(out.getvalue())
    assert mine.read("stored.txt") == b"x" * 50 and mine.read("large") == b"z" * 10
    with pytest.raises(ValueError):
        mine.read("packed.txt")
    for broken in (b"", b"PK", out.getvalue()[:-30]):
        with pytest.raises(ValueError):
            open_bytes(broken)


def test_records():
    payload = "é\r\n\r\n body".encode()
    digest = hashlib.sha256(payload).hexdigest()
    record = parse_record(record_bytes(7, "http://h/a b\r\nX: y", payload, digest, None, len(payload)))
    assert record["payload"] == payload and record["warc"]["warc-type"] == "response"
    assert record["warc"]["warc-target-uri"] == "http://h/a%20b%0D%0AX:%20y" and "x" not in record["warc"]
    again = parse_record(record_bytes(8, None, payload, digest, 7, len(payload)))
    assert again["payload"] == b"" and again["warc"]["warc-refers-to"] == "<urn:page:7>" and again["http"]["content-length"] == str(len(payload))


def expected(rows):
    first: dict = {}
    for k, html in rows:
        raw = (html or "").encode()
        if k is not None and len(raw) >= 100:
            first[raw] = min(k, first.get(raw, k))
    out = []
    for k, html in rows:
        raw = (html or "").encode()
        revisit = k is not None and raw in first and first[raw] != k
        out.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[raw] if revisit else None))
    return sorted(out, key=str)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    rows = op9_warc(spark, sf).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=str) == expected([(r["page_id"], r["html"]) for r in pages])
    assert all(r["intact"] for r in rows)


def test_odd_pages(spark):
    copies = "<p>copy</p>" * 20
    htmls = [(k, copies) for k in range(5, 40)] + [(50, "x" * 99), (51, "x" * 99), (52, "é" * 50), (53, "é" * 50), (54, None), (55, ""), (None, copies), (56, "y" * 300000), (60, "r" * 200), (60, "r" * 200)]
    df = spark.createDataFrame([(k, None if k == 51 else f"http://h/{k}", h, "own") for k, h in htmls], "page_id long, url string, html string, digest string")
    rows = archive_pages(df).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=str) == expected(htmls) and all(r["intact"] for r in rows)
    assert archive_pages(df.where("page_id < 0")).count() == 0


def test_payloads_come_back_over_several_archives(spark, tmp_path):
    df = spark.range(200).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(sha2(cast(id AS string), 256), 5) AS html")
    folder = f"file://{tmp_path}/files"
    write_archives(df.coalesce(2), folder, archive_bytes=4000, zip64=True).write.parquet(f"{tmp_path}/names")
    archives = spark.read.parquet(f"{tmp_path}/names")
    found = archives.collect()
    assert len(found) > 4 and len({r["name"] for r in found}) == len(found) and sum(r["records"] for r in found) == 200
    assert sorted(n for n in os.listdir(tmp_path / "files") if not n.startswith(".")) == sorted(r["name"] for r in found)
    for r in found:
        path = tmp_path / "files" / r["name"]
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and set(z.namelist()) == {WARC_NAME, INDEX_NAME} and path.stat().st_size == r["bytes"]
    got = {r["page_id"]: r["payload"].decode() for r in read_archives(archives, folder, payloads=True).collect()}
    assert got == {r["page_id"]: r["html"] for r in df.collect()}


@pytest.mark.parametrize("zip64", [False, True])
def test_one_record_is_a_short_range(spark, tmp_path, zip64):
    """From the central directory to the index to one record, by seeks in a file of megabytes."""
    import base64
    import random

    random.seed(2)
    rows = [(k, f"http://h/{k}", base64.b64encode(random.randbytes(30000)).decode()) for k in range(100)]
    folder = f"file://{tmp_path}/files"
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder, zip64=zip64).collect()
    holds = lambda n: any(e["page"] == 57 for e in entries_of(open_file(f"{folder}/{n}")))
    name = next(n for n in os.listdir(tmp_path / "files") if n.endswith(".zip") and holds(n))  # rows may be in several archives
    whole = open_file(f"{folder}/{name}")
    size, read = (tmp_path / "files" / name).stat().st_size, []
    counted = ZipRanges(lambda at, n: read.append(n) or whole.read_at(at, n), size)
    wanted = [e for e in entries_of(counted) if e["page"] == 57]
    (record,) = records_of(counted, wanted)
    assert record["payload"].decode() == rows[57][2] and size > 1_500_000
    assert sum(read) < 65_557 + 40_000 + 25_000 < size / 10  # the tail, a record, the index and headers


def test_very_long_payload(spark):
    df = spark.createDataFrame([(1, None, "é" * 5_000_000), (2, None, "x y " * 2_500_000), (3, None, "é" * 5_000_000)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in archive_pages(df).collect()}
    assert [rows[k]["payload_bytes"] for k in (1, 2, 3)] == [10_000_000] * 3 and rows[3]["refers_to"] == 1 and all(r["intact"] for r in rows.values())


def test_archives_are_deleted(spark):
    from cartograph.llm.common import shared_root

    root = shared_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    archive_pages(spark.createDataFrame([(1, "http://h/", "x" * 500)], "page_id long, url string, html string")).collect()
    new = set(os.listdir(root)) - before
    assert not [n for d in new for n in os.listdir(f"{root}/{d}") if n == "files"]
