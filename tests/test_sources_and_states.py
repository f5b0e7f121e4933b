import base64
import gzip
import io
import tarfile
import time

import pytest

from tessellate.sources import archives
from tessellate.streaming import states


def test_encodings_and_bundles(spark, tmp_path):
    body = b'{"a": 1}'
    (tmp_path / "i.json").write_bytes(body)
    (tmp_path / "i.json.gz").write_bytes(gzip.compress(body))
    (tmp_path / "i.json.gz.b64").write_bytes(base64.b64encode(gzip.compress(body)))
    (tmp_path / "broken.gz").write_bytes(b"\x1f\x8bxx")
    files = archives.binary_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.body for r in archives.index_files(files.filter("path not like '%broken%'")).collect()}
    assert set(got.values()) == {body.decode()} and len(got) == 3
    assert len(archives.texts(files).collect()) == 4
    assert files.filter(archives.compressed()).count() == 2
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name in ("a/x.json", "a/y.json", "../evil"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    tars = spark.createDataFrame([("s.tar", bytearray(out.getvalue()))], "path string, content binary")
    have = spark.createDataFrame([("a/y.json",)], "name string")
    assert [r.name for r in archives.extracted(tars, have).collect()] == ["a/x.json"]


def test_evidence_files_keep_the_bad_ones(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"host": "a"}')
    (tmp_path / "b.json").write_text("{bad")
    rows = {r.file: r.host for r in archives.evidence_files(spark, str(tmp_path), "host string").collect()}
    assert rows == {"a.json": "a", "b.json": None}


def test_limiter_does_not_count_what_it_refuses():
    times = [0, 1, 2, 3600, 3601]
    verdicts, _ = states.admit(times, [], most=2)
    assert [v[0] for v in verdicts] == [True, True, False, True, True]
    assert verdicts[2][1] == 3598


def test_limiter_in_batch_is_the_replay(spark):
    rows = [(c, i, (i * 37) % 5000) for c in range(3) for i in range(60)]
    got = {(r.client, r.id): r.allowed for r in states.rate_limited(spark.createDataFrame(rows, "client long, id long, t long"), most=5).collect()}
    for c in range(3):
        mine = sorted((t, i) for x, i, t in rows if x == c)
        verdicts, _ = states.admit([t for t, _ in mine], [], 5)
        assert [got[c, i] for _, i in mine] == [v[0] for v in verdicts]


def test_budget_skips_and_goes_on(spark):
    rows = [("m", 1, 1, 6), ("m", 2, 2, 5), ("m", 3, 3, 4), ("n", 4, 1, 11)]
    got = {r.id: (r.made, r.used) for r in states.within_budget(spark.createDataFrame(rows, "month string, id long, t long, cost long"), 10).collect()}
    assert got == {1: (True, 6), 2: (False, 6), 3: (True, 10), 4: (False, 0)}


@pytest.mark.parametrize("kind", ["limiter", "leads", "hours"])
def test_streams(spark, tmp_path, kind):
    source = tmp_path / "in"
    frame = spark.createDataFrame([(1, i, i * 10, time.time()) for i in range(20)], "client long, id long, t long, x double").selectExpr("*", "timestamp_seconds(1700000000 + t) AS ts", "1 AS company", "true AS is_post")
    frame.write.parquet(str(source))
    stream = spark.readStream.schema(frame.schema).parquet(str(source))
    if kind == "leads":
        states.append_leads(stream.select("client", "id"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(90)
        assert spark.read.json(str(tmp_path / "out")).count() == 20
        return
    out = states.limiter_stream(stream, most=4) if kind == "limiter" else states.hourly_activity(stream)
    q = out.writeStream.format("memory").queryName(kind).outputMode("append" if kind == "limiter" else "update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    rows = spark.table(kind).collect()
    assert (sum(r.allowed for r in rows) == 4) if kind == "limiter" else rows
