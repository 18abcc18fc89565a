import base64
import hashlib

import pytest

from zscape.llm import warc as W

PAGES = "page_id long, url string, html string, digest string, header string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "h") for r in rows], PAGES)


ROWS = [(5, "u5", "<p>é</p>"), (2, "u2", "<p>é</p>"), (7, None, None), (9, "u9", ""), (3, "u3", "a\r\n\r\nWARC/1.1\r\nb"), (3, "u3", "a\r\n\r\nWARC/1.1\r\nb"), (4, "u4", "z" * 300000), (None, "n", "<p>é</p>")]


def brute(rows):
    out, seen = [], {}
    for i, u, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        b = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((i, len(b), d, "revisit" if b in seen else "response", seen.get(b)))
        seen.setdefault(b, i)
    return sorted(map(str, out))


def test_contract(spark):
    got = W.described(W.read(spark, W.write(pages(spark, ROWS)))).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(ROWS)


def test_payloads_are_stored_once_and_records_come_back(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(W, "TOGETHER", 3)
    rows = [(i, f"u{i}", "same" if i % 2 else f"own {i} \r\n\r\n") for i in range(40)]
    folder = W.write(pages(spark, rows))
    assert spark.read.parquet(f"{folder}/payloads").count() == 21
    records = W.read(spark, folder)
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in records.collect()} == {i: h for i, _, h in rows}
    W.export(records, str(tmp_path / "out"))
    back = W.load(spark, str(tmp_path / "out")).collect()
    heads = {bytes(r["header"]) for r in records.collect()}
    assert {bytes(r["header"]) for r in back} == heads and len(back) == 40
    assert all(bytes(r["payload"]) == b"" for r in back if b"WARC-Type: revisit" in bytes(r["header"]))


def test_least_bytes_and_empty(spark):
    got = W.described(W.read(spark, W.write(pages(spark, ROWS), least_bytes=5))).collect()
    assert {r["record_type"] for r in got if r["payload_bytes"] < 5} == {"response"}
    assert W.described(W.read(spark, W.write(pages(spark, ROWS).where("false")))).count() == 0


def test_damage_is_found(spark):
    from pyspark.errors import PythonException
    from pyspark.sql import functions as F

    folder = W.write(pages(spark, ROWS))
    heads = spark.read.parquet(f"{folder}/headers").withColumn("header", F.replace("header", F.lit("sha1:"), F.lit("sha1:A")))
    heads.write.parquet(f"{folder}-b/headers")
    spark.read.parquet(f"{folder}/payloads").write.parquet(f"{folder}-b/payloads")
    with pytest.raises(PythonException):
        W.read(spark, f"{folder}-b").count()
