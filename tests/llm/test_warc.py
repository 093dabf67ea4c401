import base64
import gzip
import hashlib
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from kinetext.llm import common, warc

PAGES = "page_id long, url string, html string"
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def brute(rows, least=0):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        other = first.get(html or "") if len(data) >= least else None
        again = other is not None and other != page
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", other if again else None))
    return sorted(out, key=repr)


def got(df, columns=COLUMNS):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


ODD = [
    (1, "http://a.com/", "same"), (2, "http://a.com/x y\r\nWARC-Type: evil", "same"), (2, "http://b.com", "same"), (1, "http://a.com/", "same"), (3, None, None), (4, "no address", ""), (5, "http://[bad", "ä€𝄞\r\n\r\nWARC/1.1\r\n"),
    (None, "http://c.com", "same"), (None, None, "alone"), (None, None, "alone"), (-7, "http://d.com/ü?q=1#f", "x" * 3_000_000), (8, "http://e.com", "x" * 3_000_000), (9, "http://f.com", "\x00﻿"),
]


@pytest.mark.parametrize("least", [0, 1, 5])
def test_odd_pages(spark, least):
    df = spark.createDataFrame(ODD, PAGES).repartition(3)
    assert got(warc.archive(df, least=least)) == brute(ODD, least)


def test_empty_tables_and_clashing_columns(spark, monkeypatch):
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0
    monkeypatch.setattr(common, "BROADCAST_LIMIT", -1)
    df = spark.createDataFrame(ODD, PAGES).withColumns({c: F.lit(1) for c in ("id", "payload", "digest", "first", "n", "path", "Records")})
    assert got(warc.archive(df)) == brute(ODD)


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("a/b %c+ä", None, "x"), ("b", None, "x"), (None, None, "y")], "page_id string, url string, html string")
    assert got(warc.archive(df)) == brute([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("big", [False, True])
def test_packages_in_many_runs(spark, monkeypatch, tmp_path, big):
    """Small limits: several packages a task, many runs a package, and (big) ZIP64 structures throughout."""
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 20_000)
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 7}.com/{i}", "".join(rng.choices("abcdef", k=rng.randint(0, 900)))) for i in range(300)]
    if not big:
        assert got(warc.archive(spark.createDataFrame(rows, PAGES), str(tmp_path / "p"))) == brute(rows)
        return
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    monkeypatch.setattr(warc, "RUN_BYTES", 3_000)
    package = warc.Package(str(tmp_path))
    for page, url, html in rows:
        package.add(url, warc.page_record(str(page), url, html.encode(), None)[1])
    path, n, _ = package.close()
    data = open(path, "rb").read()
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    for before in (b"", b"#!/bin/sh\n" * 50):  # with something before the package too
        whole = before + data
        reads = []

        def read(at, length, whole=whole, reads=reads):
            reads.append(length)
            return whole[at : at + length]

        runs = list(warc.runs_of(read, len(whole)))
        assert len(runs) > 5 and sum(reads) < len(whole) / 2 + 70_000
        found = [warc.parsed(x) for run in runs for x in warc.records(read, *run)]
        assert len(found) == n == 301 and sorted(x[8].decode() for x in found if x[1] == "response") == sorted(r[2] for r in rows)
        assert all(x[6] for x in found if x[1] == "response")


def package(members, method=zipfile.ZIP_STORED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members.items():
            z.writestr(name, data)
        z.comment = comment
    return out.getvalue()


def test_packages_of_others(spark, tmp_path):
    """Plain and compressed archives, without an index, with one that has gaps, and with a compressed one."""
    page = lambda i, kind="response": warc.record(kind, f"urn:x:{i}", {"WARC-Target-URI": f"http://x/{i}"}, f"block {i}".encode() * i)
    zipped = [gzip.compress(page(i)) for i in range(40)]
    ends = [sum(map(len, zipped[: i + 1])) for i in range(40)]
    line = lambda i, name: f"k 2020 {json.dumps({'filename': name, 'offset': ends[i] - len(zipped[i]), 'length': len(zipped[i])})}\n"
    index = "".join(line(i, "b.warc.gz") for i in range(40)) + "".join(line(i, "c.warc.gz") for i in (1, 5))
    (tmp_path / "one.wacz").write_bytes(package({"archive/a.warc": b"".join(page(i) for i in range(30)), "archive/b.warc.gz": b"".join(zipped), "archive/c.warc.gz": b"".join(zipped), "indexes/i.cdx.gz": gzip.compress(index.encode()), "pages/pages.jsonl": "{}", "archive/empty.warc": b""}, comment=b"PK\x05\x06 a comment"))
    (tmp_path / "two.wacz").write_bytes(package({}))
    paths = spark.createDataFrame([(f"file://{tmp_path}/one.wacz",), (None,), (f"file://{tmp_path}/two.wacz",)], "path string")
    found = warc.read_packages(paths, payload=True).collect()
    want = [f"urn:x:{i}" for n in (30, 40, 40) for i in range(n)]
    assert sorted(r["record_id"] for r in found) == sorted(want)
    assert all(bytes(r["payload"]).decode() == f"block {(i := int(r['record_id'][6:]))}" * i and r["sound"] is None for r in found)


def test_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "deflated.wacz").write_bytes(package({"archive/a.warc": b"x" * 999}, zipfile.ZIP_DEFLATED))
    paths = spark.createDataFrame([(f"file://{tmp_path}/deflated.wacz",)], "path string")
    assert warc.read_packages(paths, skip_packed=True).count() == 0
    with pytest.raises(Exception, match="can't be read by ranges"):
        warc.read_packages(paths)
    for data in (b"", b"no package", b"PK\x05\x06" + b"\xff" * 18, package({"archive/a.warc": b""})[:-30]):
        with pytest.raises(ValueError):
            list(warc.members(lambda at, n, data=data: data[at : at + n], len(data)))
    wrong = warc.record("response", "urn:x:1", {"WARC-Payload-Digest": "sha1:AAAA"}, b"x")
    assert warc.parsed(wrong)[6] is False
