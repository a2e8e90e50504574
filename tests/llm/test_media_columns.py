import hashlib
import os
import zlib

import pytest

from catalogspark.llm import media_columns as m

TEXTS = ["", None, "a", "x" * 192, "y" * 193, "é漢🙂 " * 50, "z" * 300_000, "a", "RIFF\0data"]


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(None if i == 2 else i, t, "k") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return m.store(docs, folder=str(tmp_path / "media"))


def want(t):
    raw = (t or "").encode()
    p = raw + b" " * (-len(raw) % 192 if raw else 192)
    return len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])


def test_round_trip(spark, folder):
    for size in (200, 1 << 25):
        got = m.describe(m.load(spark, folder, range_bytes=size)).collect()
        assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(map(want, TEXTS))
        assert len({(r.payload_sha256, r.n_bytes) for r in got}) == len({(r.media_sha256, r.feature) for r in got})


def test_query(spark, folder, tmp_path):
    got = {r.doc_id: r for r in m.op3_media_columns(spark, str(tmp_path)).collect()}
    assert set(got) == {None, 0, 1, 3, 4, 5, 6, 7, 8}
    assert got[0].media_sha256 == got[1].media_sha256 and got[None].media_sha256 == got[7].media_sha256


def test_members_fail_alone(spark, folder):
    name = max((os.path.join(folder, "archives", f) for f in os.listdir(f"{folder}/archives") if f.endswith(".zip")), key=os.path.getsize)
    with open(name, "r+b") as f:
        f.seek(60)
        f.write(b"\xff" * 20)
    got = m.load(spark, folder, on_error="row", tries=2).collect()
    assert len(got) == len(TEXTS) and 1 == sum(r.error is not None for r in got)
    with pytest.raises(Exception):
        m.load(spark, folder, tries=1).collect()


def test_no_rows(spark, tmp_path):
    folder = m.store(spark.createDataFrame([], "doc_id long, text string"), folder=str(tmp_path / "none"))
    assert m.load(spark, folder).count() == 0
