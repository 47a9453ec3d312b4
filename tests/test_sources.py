"""Sources, sinks and Unicode functions on small inputs."""

import hashlib
import json
import struct
import zlib

from pyspark.sql import functions as F

from evidra.functions import unicode as un
from evidra.sources import files, uploads


def test_uploads(spark, tmp_path):
    """A row for every file: empty, large, badly named, badly encoded, encrypted and broken ones too."""
    page = b"1 0 obj << /Type /Page >> endobj "
    packed = b"5 0 obj << /Type /ObjStm /Filter /FlateDecode >> stream\n" + zlib.compress(b"<</Type/Page>> <</Type /Pages>> <</Type/Page>>") + b"\nendstream"
    made = {
        "a.txt": ("héllo\r\n".encode(), "OK", 1, "héllo\r\n"), "b.txt": (b"", "EMPTY", None, None), "c.TXT": (b"\xff\xfe", "NOT_UTF8", None, None), "d.exe": (b"x", "BAD_NAME", None, None),
        "e.pdf": (b"%PDF-1.4 " + page * 2 + b"<< /Type /Pages >>", "OK", 2, None), "f.pdf": (b"PDF", "UNREADABLE", None, None), "g.pdf": (b"%PDF-1.4 /Encrypt 5 0 R " + page, "ENCRYPTED", None, None),
        "h.pdf": (b"%PDF-1.4 " + page * 301, "TOO_MANY_PAGES", 301, None), "i.txt": (b"x" * (uploads.MAX_BYTES + 1), "TOO_LARGE", None, None), "j.txt": (b"x" * uploads.MAX_BYTES, "OK", 1, None),
        "k.txt": (b" \n", "BLANK", 1, None), "sub/l.txt": (b"x", "BAD_NAME", None, None), "m.pdf": (b"%PDF-1.5 " + packed, "OK", 2, None), "n\\o.txt": (b"x", "BAD_NAME", None, None),
    }
    for name, (data, *_) in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    spark.dataSource.register(uploads.Uploads)
    df = spark.read.format("uploads").option("partitions", 3).load(f"file://{tmp_path}")
    got = {r.name: (r.verdict, r.pages, r.text if r.name != "j.txt" else None) for r in df.collect()}
    assert got == {k: v[1:] for k, v in made.items()} and df.rdd.getNumPartitions() == 3
    assert df.where("name = 'a.txt'").first().digest == hashlib.sha256("héllo\r\n".encode()).hexdigest()
    (tmp_path / "none").mkdir()
    assert spark.read.format("uploads").load(f"file://{tmp_path}/none").count() == 0


def test_shares_are_even():
    files = [(f"p{k}", f"n{k}", (k * 7919) % 1_000_000) for k in range(300)]
    got = uploads.shares(files, 16)
    sizes = [sum(f[2] for f in s.files) for s in got]
    assert sorted(f for s in got for f in s.files) == sorted(files) and max(sizes) < 1.02 * min(sizes)


def test_question_faults(spark, tmp_path):
    one = {"questionId": "q1", "query": "x", "expectedEvidence": [{"fixtureEvidenceId": "e", "relevance": 2, "evidenceGroupId": "g"}], "noEvidence": False, "split": "TEST"}
    rows = [one, one | {"questionId": "q2", "query": " ", "split": "DEV"}, one | {"questionId": "q3", "noEvidence": True}, one | {"questionId": "q4", "expectedEvidence": []}, one | {"questionId": "q4"}]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = sorted(map(tuple, files.question_faults(files.questions(spark, f"file://{tmp_path}/q.jsonl")).collect()))
    assert got == [("q2", "BLANK_QUERY"), ("q2", "SPLIT"), ("q3", "NO_EVIDENCE_HAS_SOME"), ("q4", "EVIDENCE_MISSING"), ("q4", "REPEATED_ID")]


def test_replace_versions_keeps_others(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows = lambda v, n: spark.range(n).select(F.col("id").alias("chunk"), F.lit(v).alias("version_id"))
    assert files.replace_versions(rows(1, 5).unionByName(rows(2, 3)), folder) == 8
    assert files.replace_versions(rows(2, 2), folder) == 2
    assert spark.read.parquet(folder).count() == 7


def test_unicode(spark):
    df = spark.createDataFrame([("Ｄａｔａ　①", ["a", None, "é"]), (None, None), ("  ", [])], "t string, p array<string>")
    got = df.select(un.normalized("t").alias("n"), un.tag_name("t").alias("g"), un.canonical_digest("p").alias("d")).collect()
    want = hashlib.sha256(struct.pack(">iI", 3, 1) + b"a" + struct.pack(">iI", -1, 2) + "é".encode()).hexdigest()
    assert [(r.n, r.g) for r in got] == [("data 1", "Data 1"), (None, None), ("  ", None)]
    assert got[0].d == want and got[1].d is None and got[2].d == hashlib.sha256(b"\0\0\0\0").hexdigest()
