import hashlib
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest

from tesseral.llm import media
from tesseral.llm.queries import op3_media_columns


def payload_of(text):
    data = (text or "").encode()
    return data + b"\xff" * (-len(data) % 576 or (0 if data else 576))


def test_png_round_trip():
    for n in (1, 2, 7, 8, 9, 100):
        data = np.random.default_rng(n).integers(0, 256, 576 * n, np.uint8).tobytes()
        assert media.from_png(media.to_png(data)).tobytes() == data
    damaged = bytearray(media.to_png(bytes(576)))
    damaged[50] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(damaged))
    with pytest.raises(ValueError):
        media.to_png(b"")


def test_query_against_brute_force(spark, sf_dir, documents):
    got = op3_media_columns(spark, sf_dir).collect()
    assert len(got) == len(documents)
    texts = {r["doc_id"]: r["text"] for r in documents}
    for r in got:
        p = payload_of(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len((texts[r["doc_id"]] or "").encode()), len(p))
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(p[-32:])
        image = media.to_png(p)
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        assert r["feature"] == media.image_feature(media.from_png(image))


def test_odd_rows_and_small_archives(spark, odd, none, tmp_path):
    path = f"file://{tmp_path}/m"
    media.store_payloads(odd, path, archiveBytes="800")
    got = media.read_media(spark, path, rangeBytes="300", batchBytes="500").collect()
    assert Counter((r["doc_id"], bytes(r["payload"])) for r in got) == Counter((r["doc_id"], payload_of(r["text"])) for r in odd.collect())
    assert {r["doc_id"]: r["n_bytes"] for r in got}[3] == 0
    media.store_payloads(none, f"file://{tmp_path}/n")
    assert media.read_media(spark, f"file://{tmp_path}/n").count() == 0


def test_members_are_retried_by_offset(tmp_path):
    path = f"{tmp_path}/a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(3):
            z.writestr(f"{i}/{i}.png", media.to_png(bytes([i]) * 576))
    reader = media.PngArchiveReader({"path": str(tmp_path), "waits": "0"})

    class Flaky:
        opened = 0

        def open_input_file(self, p):
            Flaky.opened += 1
            if Flaky.opened < 3:
                raise OSError("lost")
            return open(p, "rb")

    member = zipfile.ZipFile(path).infolist()[1]
    assert media.from_png(reader.fetch(Flaky(), path, [], member)).tobytes() == b"\1" * 576
    assert Flaky.opened == 3
    Flaky.opened = -10
    with pytest.raises(OSError, match="offset"):
        reader.fetch(Flaky(), path, [], member)


def test_opening_is_tried_again(spark, tmp_path, monkeypatch):
    """A first opening that fails costs neither the partition nor a member."""
    path = f"file://{tmp_path}/archives"
    media.store_payloads(spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string").coalesce(1), path)
    reader = media.PngArchiveReader({"path": path, "waits": "0"})
    true, failures = media.zipfile.ZipFile, [OSError("gone"), media.zipfile.BadZipFile("cut")]

    def opening(*args, **kwargs):
        if failures:
            raise failures.pop()
        return true(*args, **kwargs)

    monkeypatch.setattr(media.zipfile, "ZipFile", opening)
    got = [i for part in reader.partitions() for batch in reader.read(part) for i in batch.column(0).to_pylist()]
    assert sorted(got) == list(range(5)) and not failures


def test_unreachable_stores_are_refused():
    with pytest.raises(ValueError, match="abfss"):
        media._open_fs("abfss://c@a.dfs.example/x")
