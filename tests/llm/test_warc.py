"""WARC archives: round trips, revisits, chunks, archives of others."""

import collections
import glob
import gzip
import hashlib
import tracemalloc

import pytest
from pyspark.sql import functions as F

from limber.llm import warc

PAGES = "page_id long, url string, html string"


def frame(spark, rows):
    """Pages with columns whose names the operator might use itself."""
    return spark.createDataFrame(rows, PAGES).select("*", *[F.lit(7).alias(c) for c in ("payload", "digest", "chunk_no", "data", "first_id", "n", "record_type", "last")])


def brute(rows):
    groups = collections.defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ids = [x for x in groups[b] if x is not None]
        again = len(b) >= 100 and bool(ids) and i != min(ids)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    long = "<p>" + "é€𝄞x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3000
    copies = "<html>" + "same " * 40
    rows = [(i, f"http://x/{i}", copies) for i in (9, 4, 12, 7)]
    rows += [(20 + i, None, "a" * n) for i, n in enumerate((0, 1, 99, 100, 101))]
    rows += [(40 + i, "http://y/a b\r\nEvil: 1", "a" * n) for i, n in enumerate((0, 1, 99, 100, 101))]
    rows += [(60, "u", None), (61, "ü", ""), (62, "u", long), (63, "u", long + "."), (64, "u", long)]
    rows += [(None, "u", copies), (None, None, "only without id " * 20), (None, "u", "only without id " * 20)]
    rows += [(70, "u", "twice " * 50), (70, "u", "twice " * 50), (71, "u", "twice " * 50), (72, "u", "one of two " * 50), (72, "u", "two of two " * 50)]
    return rows


def test_round_trip(spark, rows):
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.warc_report(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert warc.warc_report(frame(spark, rows).limit(0)).count() == 0


def test_chunks_carry_the_payload(spark, rows, tmp_path):
    marked = warc.marked_pages(frame(spark, rows))
    manifest = warc.write_archives(marked, f"file://{tmp_path}/archives", chunk=1000, roll=20_000)
    files = sorted(glob.glob(f"{tmp_path}/archives/*"))
    assert sorted(r["archive"] for r in manifest.collect()) == [f"file://{f}" for f in files] and len(files) > 1
    assert manifest.agg(F.sum("n_records")).head()[0] == len(rows)
    for given in (manifest, warc.archive_files(spark, f"{tmp_path}/archives")):
        by = collections.defaultdict(list)
        for r in warc.read_chunks(given, chunk=777).collect():
            by[r["archive"], r["record_no"]].append(r)
        assert len(by) == len(rows)
        payloads = []
        for chunks in by.values():
            chunks.sort(key=lambda r: r["chunk_no"])
            assert [r["chunk_no"] for r in chunks] == list(range(len(chunks))) and [r["last"] for r in chunks] == [False] * (len(chunks) - 1) + [True]
            so_far = b""
            for r in chunks:
                so_far += bytes(r["data"])
                assert len(r["data"]) <= 777 and r["bytes_so_far"] == len(so_far) and r["sha256_so_far"] == hashlib.sha256(so_far).hexdigest()
            if chunks[0]["record_type"] == "response":
                payloads.append((chunks[0]["page_id"], so_far.decode()))
            else:
                assert so_far == b"" and chunks[0]["http_length"] >= 100
        kept = [(str(i), h or "") for (i, _, h) in rows if i is not None and (i, kind(rows, i, h)) == (i, "response")]
        assert sorted(p for p in payloads if p[0] is not None) == sorted(kept)
    records = warc.read_records(manifest)
    assert records.where("intact = false").count() == 0
    responses = {r["record_id"]: r for r in records.where("record_type = 'response'").collect()}
    assert all(warc.record_id(r["refers_to"], r["payload_digest"]) in responses for r in records.where("record_type = 'revisit'").collect())
    urls = {r["target_uri"] for r in records.collect()}
    assert {None, "ü", "http://y/a%20b%0D%0AEvil:%201"} <= urls


def kind(rows, page, html):
    return next(r[3] for r in brute(rows) if r[0] == page and r[2] == hashlib.sha256((html or "").encode()).hexdigest())


def test_archives_of_others(spark, tmp_path):
    """Plain and gzipped archives, whole in one member, with other record types, folded fields, LF ends and a record that breaks off."""
    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello"
    sha = hashlib.sha256(b"hello").hexdigest()
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 12\r\n\r\nsoftware: x\n\r\n\r\n"
    two = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:a>\r\nWARC-Target-URI: http://a/\r\n  b\r\nWARC-Payload-Digest: sha256:" + sha.encode() + b"\r\nContent-Type: application/http\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    wrong = two.replace(sha.encode(), b"0" * 64)
    short = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 100\r\n\r\nonly this"
    (tmp_path / "a.warc").write_bytes(one + two + wrong + short)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one + two) + gzip.compress(wrong))
    cut = gzip.compress(one) + gzip.compress(two)
    (tmp_path / "c.warc.gz").write_bytes(cut[:-20])
    (tmp_path / "d.warc").write_bytes(b"")
    files = warc.archive_files(spark, str(tmp_path))
    got = collections.defaultdict(list)
    for r in warc.read_records(files).orderBy("record_no").collect():
        got[r["archive"][-9:].strip("/")].append((r["record_type"], r["payload_bytes"], r["intact"]))
    whole = [("warcinfo", 12, None), ("response", 5, True), ("response", 5, False)]
    assert next(v for k, v in got.items() if k.endswith("a.warc")) == whole
    assert next(v for k, v in got.items() if "b.warc.gz" in k) == whole
    assert next(v for k, v in got.items() if "c.warc.gz" in k)[:1] == whole[:1]
    assert not any("d.warc" in k for k in got)
    parts = warc.read_chunks(files.where("archive like '%a.warc'")).where("record_no = 3").collect()
    assert [(bytes(r["data"]), r["last"]) for r in parts] == [(b"only this", False)]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.warc").write_bytes(b"no archive\n")
    with pytest.raises(Exception, match="no WARC record"):
        warc.read_records(warc.archive_files(spark, f"{tmp_path}/e")).collect()


def test_reading_does_not_hold_a_record(tmp_path):
    size = 64 << 20
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: {size}\r\n\r\n".encode()
    with gzip.open(tmp_path / "big.warc.gz", "wb", compresslevel=1) as f:
        f.write(head)
        for _ in range(size >> 20):
            f.write(bytes(1 << 20))
        f.write(b"\r\n\r\n")
    tracemalloc.start()
    with gzip.open(tmp_path / "big.warc.gz") as f:
        for row in warc.records_of(f, warc.CHUNK):
            last = row
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert last[-1] and last[-3] == size and last[-2] == hashlib.sha256(bytes(size)).hexdigest() and most < 4 << 20
