import hashlib
import zipfile
import zlib

import numpy as np
import pytest

from curvelab.llm import media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 200_000])
def test_png_round_trip(n):
    text = bytes(np.random.default_rng(n).integers(1, 256, n, dtype=np.uint8))
    payload = media.padded(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(text) and not payload[n:].strip(b"\0")
    assert media.decode_png(media.encode_png(payload)).tobytes() == payload


def test_damage_is_noticed():
    image = bytearray(media.encode_png(media.padded(b"hello")))
    image[50] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(image))


@pytest.mark.parametrize("options", [{}, {"archive_bytes": 1000, "range_bytes": 300, "batch_bytes": 100}])
def test_round_trip(spark, make, odd, options):
    rows = [*odd, *((100 + i, f"é{i} " * i) for i in range(50))]
    got = media.stored_features(make(rows, extra=True).repartition(3), **options).collect()
    assert all(r.error is None for r in got)
    want = []
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        p = media.padded(data)
        want.append((doc_id, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.payload_sha256, tuple(r[5:8])) == tuple(r[5:8])


def test_members_are_retried_alone(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(3):
            z.writestr(f"m{k}", bytes([k]) * 100)
    infos, opened = zipfile.ZipFile(path).infolist(), []

    def flaky(again):
        opened.append(again)
        if len(opened) < 3:
            raise OSError("gone")
        return path.open("rb")

    assert media.read_member(flaky, infos[1], pause=0) == (b"\x01" * 100, None) and opened == [False, True, True]
    raw = bytearray(path.read_bytes())
    raw[infos[1].header_offset + 40] ^= 1
    path.write_bytes(raw)
    data, error = media.read_member(lambda again: path.open("rb"), infos[1], pause=0)
    assert data is None and "directory" in error
    assert media.read_member(lambda again: path.open("rb"), infos[2], pause=0)[1] is None


def test_a_bad_member_is_a_row_with_an_error(spark, make):
    from curvelab.llm.common import new_path

    spark.dataSource.register(media.MediaArchive)
    path = new_path(spark, "media-test")
    media.images(make([(1, "one"), (2, "two")]).coalesce(1)).write.format(media.FORMAT).mode("append").option("path", path).save()
    import pathlib

    (archive,) = pathlib.Path(path.removeprefix("file://")).glob("*.zip")
    raw, first = bytearray(archive.read_bytes()), zipfile.ZipFile(archive).infolist()[0]
    raw[first.header_offset + 60] ^= 1
    archive.write_bytes(raw)
    got = {r.doc_id: r for r in media.features(spark.read.format(media.FORMAT).option("path", path).option("retries", 1).load()).collect()}
    assert got[1].error and got[1].payload_sha256 is None and got[2].error is None and got[2].n_bytes == 3


def test_empty_table(spark, make):
    assert media.stored_features(make([])).collect() == []


def test_appending_and_overwriting(spark, make):
    from curvelab.llm.common import new_path

    spark.dataSource.register(media.MediaArchive)
    path = new_path(spark, "media-test")
    put = lambda rows, mode: media.images(make(rows)).write.format(media.FORMAT).mode(mode).option("path", path).save()
    ids = lambda: sorted(r.doc_id for r in media.features(spark.read.format(media.FORMAT).option("path", path).load(), strict=True).collect())
    put([(1, "one")], "append")
    put([(2, "two"), (3, "three")], "append")
    assert ids() == [1, 2, 3]
    put([(4, "four")], "overwrite")
    assert ids() == [4]
    put([], "append")
    assert ids() == [4]


def test_the_query_fails_on_a_member_it_cannot_read(spark, make, monkeypatch):
    import pathlib

    from curvelab.llm import common

    made = []
    monkeypatch.setattr(media, "new_path", lambda s, name: made.append(common.new_path(s, name)) or made[-1])
    rows = media.stored_features(make([(1, "one"), (2, "two")]), retries=1)
    archive = next(pathlib.Path(made[0].removeprefix("file://")).glob("*.zip"))
    raw, first = bytearray(archive.read_bytes()), zipfile.ZipFile(archive).infolist()[0]
    raw[first.header_offset + 60] ^= 1
    archive.write_bytes(raw)
    with pytest.raises(Exception, match="directory"):
        rows.collect()


def test_planned_ranges_are_bounded(tmp_path, monkeypatch):
    import json

    (tmp_path / f"{media.MANIFEST}x.json").write_text(json.dumps([["a.zip", 10_000_000], ["b.zip", 5_000_000]]))
    monkeypatch.setattr(media, "TASKS", 10)
    parts = media._Reader(f"file://{tmp_path}", 1000, 1, 1).partitions()
    assert len(parts) <= 12
    for name, size in (("a.zip", 10_000_000), ("b.zip", 5_000_000)):
        spans = sorted(p.value[1:] for p in parts if p.value[0] == name)
        assert spans[0][0] == 0 and spans[-1][1] >= size and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
