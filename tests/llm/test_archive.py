import base64
import glob
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factlane.llm import archive
from factlane.llm.store import new_path


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(8)
    bodies = ["", None, "<p>é\r\n\r\nWARC/1.1\r\n</p>", "x" * 200_000, *["".join(r.choice("ab<>\n") for _ in range(40)) for _ in range(5)]]
    rows = [(i, None if i % 9 == 0 else f"http://h/{i}\r\nX: y", r.choice(bodies), "extra") for i in range(60)]
    rows += [(7, "http://h/7b", rows[7][2], "extra"), (None, "http://n", "<p>only here</p>", "e"), (None, "http://n", bodies[4], "e"), rows[5]]
    return spark.createDataFrame(rows, "page_id long, url string, html string, number string"), rows


def test_index_matches_brute_force(pages):
    df, rows = pages
    got = archive.archive_round_trip(df)
    last = {}
    for i, _, html, _ in rows:
        payload = (html or "").encode()
        last[payload] = max(last.get(payload, -1), -1 if i is None else i)
    by_page, responses = {}, {}
    for r in got.collect():
        by_page.setdefault(r.page_id, []).append(r)
        if r.record_type == "response":
            responses[r.payload_digest] = responses.get(r.payload_digest, 0) + 1
    for i, _, html, _ in rows:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        mine = [r for r in by_page[i] if r.payload_digest == digest]
        assert mine and all(r.payload_bytes == len(payload) for r in mine)
        for r in mine:
            assert (r.record_type == "response" and r.refers_to is None and (i is None or i == last[payload])) or (
                r.record_type == "revisit" and r.refers_to == (None if last[payload] < 0 else last[payload]))
    assert set(responses.values()) == {1}
    assert got.count() == len(rows)


def parse_warc(data):
    """Records of a WARC file, from their content lengths."""
    out = []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1")
        n = int(fields[b"Content-Length"])
        out.append((fields, data[:n]))
        assert data[n : n + 4] == b"\r\n\r\n"
        data = data[n + 4 :]
    return out


def test_records_and_files_are_whole(spark, pages):
    df, rows = pages
    path = new_path(spark, "archive-test")
    archive.write_archive(df, path)
    records = archive.read_records(spark, path).collect()
    assert len(records) == len(rows)
    headers = {bytes(r.header) for r in spark.read.parquet(f"{path}/records").collect()}
    for r in records:
        (fields, block), = parse_warc(bytes(r.record))
        assert any(bytes(r.record).startswith(h) for h in headers)
        assert block == (b"" if r.record_type == "revisit" else bytes(r.payload))
    archive.export_warc(spark, path, f"{path}/warc")
    found = []
    for name in glob.glob(f"{path.removeprefix('file:')}/warc/part-*"):
        with open(name, "rb") as f:
            found += parse_warc(f.read())
    stored = sorted(bytes(r.payload) for r in spark.read.parquet(f"{path}/payloads").collect())
    assert sorted(b for f, b in found if f[b"WARC-Type"] == b"response") == stored
    assert len(found) == len(rows) and len({f[b"WARC-Record-ID"] for f, _ in found}) == len(rows)


def test_small_payloads_may_stay_responses(spark, pages):
    df, rows = pages
    path = new_path(spark, "archive-test")
    archive.write_archive(df, path, min_revisit_bytes=100)
    for r in archive.read_index(spark, path).collect():
        assert r.record_type == "response" or r.payload_bytes >= 100


def test_a_changed_payload_is_found_out(spark, pages):
    df, _ = pages
    path = new_path(spark, "archive-test")
    archive.write_archive(df, path)
    stored = spark.read.parquet(f"{path}/payloads")
    stored.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{path}-bad/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}-bad/records")
    with pytest.raises(Exception, match="does not have the digest"):
        archive.read_index(spark, f"{path}-bad").collect()


def test_a_changed_header_is_found_out(spark, pages, monkeypatch):
    df, _ = pages
    write = archive.write_archive

    def write_wrong(pages, path, *args):
        write(pages, f"{path}-good", *args)
        spark.read.parquet(f"{path}-good/payloads").write.parquet(f"{path}/payloads")
        text = F.col("header").cast("string")
        wrong = F.regexp_replace(text, r"Content-Length: (\d+)", "Content-Length: 1$1").cast("binary")
        spark.read.parquet(f"{path}-good/records").withColumn("header", wrong).write.parquet(f"{path}/records")

    monkeypatch.setattr(archive, "write_archive", write_wrong)
    with pytest.raises(Exception, match="length or digest of its header"):
        archive.archive_round_trip(df).collect()


def test_empty_table(spark):
    assert archive.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
