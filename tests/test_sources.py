"""Archives, labels, manifests and texts of pages, by hand-made files."""

import hashlib
import io
import json
import zipfile

import pytest

from quire.sources import files as S


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    members = [("a/one.png", b"1"), ("../out.png", b"x"), ("/abs.png", b"x"), ("__MACOSX/a.png", b"x"), ("a/.hidden", b"x"), ("b/", b""), ("two.txt", b"")]
    (tmp_path / "x.zip").write_bytes(archive(members))
    (tmp_path / "y.txt").write_text("no archive")
    got = S.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r["name"], bytes(r["content"])) for r in got) == [("a/one.png", b"1"), ("two.txt", b"")]
    assert all(r["digest"] == hashlib.sha256(bytes(r["content"])).hexdigest() for r in got)
    with pytest.raises(ValueError):
        list(S.archive_members(archive([("big", b"0" * 3_000_000)]), 2_000_000))


def test_labels_of_models(spark, tmp_path):
    box = {"x1": 0, "y1": 0, "x2": 5, "y2": 5}
    line = lambda n: {"name": "DefaultLine", "class": 1, "confidence": 0.5, "box": box, "segments": {"x": [1.0] * n, "y": [1.0] * n}}
    for model, rows in (("zone", [{"name": "MainZone", "class": 0, "confidence": 0.9, "box": box}]), ("lines", [line(2), line(3)])):
        (tmp_path / model).mkdir()
        (tmp_path / model / "p1.json").write_text(json.dumps(rows))
    got = S.read_labels(spark, {m: str(tmp_path / m) for m in ("zone", "lines")}).orderBy("model_order", "n").collect()
    assert [(r["image"], r["model"], r["n"], r["name"]) for r in got] == [("p1", "zone", 0, "MainZone"), ("p1", "lines", 1, "DefaultLine")]


def test_manifest_images_and_side_texts(spark):
    manifest = spark.createDataFrame([("a", 1), ("b", 2)], "image_sha256 string, page_id int")
    images = spark.createDataFrame([("a", "y"), ("a", "x")], "image_sha256 string, path string")
    assert sorted((r["page_id"], r["path"]) for r in S.pages_of_images(manifest, images).collect()) == [(1, "x"), (2, None)]
    rows = [(1, 2, "Margin", "late"), (1, 0, "Title", "top"), (1, 1, "Margin", "early"), (1, 3, "Title", " "), (2, 0, "Title", None)]
    side = S.secondary_text(spark.createDataFrame(rows, "page int, position int, label string, text string")).collect()
    assert [tuple(r) for r in side] == [(1, "[Title]\ntop\n\n[Margin]\nearly\nlate\n")]
