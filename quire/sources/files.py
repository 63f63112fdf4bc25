"""Readers and writers of the files that pages come from and reports go to."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = "*.{png,jpg,jpeg,tif,tiff,bmp,webp}"


def read_images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, content, digest and length of image files, one row for each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("image_sha256"), "content")


def read_manifest(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Rows of a JSON-lines manifest; blank lines and those that begin with # don't count. A line that isn't JSON or lacks a
    required key is an error when read."""
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    parsed = rows.select("value", F.from_json("value", schema).alias("r"))
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(f"r.{c}").isNotNull()
    checked = F.when(F.coalesce(whole, F.lit(False)), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("manifest line lacks a key: "), F.col("value"))))
    return parsed.select(checked.alias("r")).select("r.*")


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """page_id, reading, text of a JSON document {page: {reading: text}}."""
    whole = spark.read.option("wholetext", "true").text(path)
    pages = whole.select(F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("page_id", "readings"))
    return pages.select("page_id", F.explode("readings").alias("reading", "text"))


SKIPPED = ("__MACOSX", "._", "Thumbs.db", ".")
PART = 1 << 20  # bytes read of a member at a time


def archive_members(content: bytes, most: int) -> Iterator[tuple[str, bytes]]:
    """name and bytes of the files of a ZIP archive, without folders, system files and names that lead out of it. An archive that
    unfolds to more than `most` bytes is an error, found before more than that is held."""
    left = most
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for member in z.infolist():
            name = posixpath.normpath(member.filename.replace("\\", "/"))
            outside = name.startswith(("/", "../")) or name == ".." or (len(name) > 1 and name[1] == ":")
            if member.is_dir() or outside or any(p.startswith(SKIPPED) for p in name.split("/")):
                continue
            parts = []
            with z.open(member) as f:
                while part := f.read(PART):
                    left -= len(part)
                    if left < 0:
                        raise ValueError(f"an archive unfolds to more than {most} bytes")
                    parts.append(part)
            yield name, b"".join(parts)


def read_archives(spark: SparkSession, path: str, most: int = 512 << 20) -> DataFrame:
    """archive, name, content, digest of the files in ZIP archives, a task for each archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                for name, data in archive_members(content.as_py(), most):
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([name]), pa.array([data], pa.binary())], names=["archive", "name", "content"])

    return files.mapInArrow(unfold, "archive string, name string, content binary").withColumn("digest", F.sha2("content", 256))


LABELS = "struct<predictions: array<struct<name: string, class: int, confidence: double, box: struct<x1: double, y1: double, x2: double, y2: double>, segments: struct<x: array<double>, y: array<double>>>>>"


def read_labels(spark: SparkSession, folders: dict[str, str], lines: tuple[str, ...] = ("DefaultLine",)) -> DataFrame:
    """image, model, n, name, confidence, box, segments of label files (an array of predictions for each image), of several models
    in the order given. Lines with an outline of fewer than three points go."""
    out = None
    for k, (model, path) in enumerate(folders.items()):
        whole = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path).select(F.col("_metadata.file_name").alias("file"), "value")
        rows = F.from_json(F.concat(F.lit('{"predictions":'), "value", F.lit("}")), LABELS)["predictions"]
        each = whole.select(F.regexp_replace("file", r"\.json$", "").alias("image"), F.lit(k).alias("model_order"), F.lit(model).alias("model"), F.posexplode(rows).alias("n", "p"))
        found = each.select("image", "model_order", "model", "n", F.col("p.name").alias("name"), F.col("p.confidence").alias("confidence"), F.col("p.box").alias("box"), F.col("p.segments").alias("segments"))
        out = found if out is None else out.unionByName(found)
    short = F.col("name").isin(*lines) & F.col("segments").isNotNull() & (F.size("segments.x") < 3)
    return out.filter(~F.coalesce(short, F.lit(False)))


def pages_of_images(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """manifest (image_sha256, …) with the path of the image that has the digest, the first of several; null for none."""
    first = images.groupBy("image_sha256").agg(F.min("path").alias("path"))
    return manifest.join(first, "image_sha256", "left")


def secondary_text(regions: DataFrame, separator: str = "\n") -> DataFrame:
    """page and text: texts of a page's side regions (page, position, label, text) under their labels, labels in the order in which
    they first come, empty texts left out; pages without any don't show."""
    rows = regions.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"])
    parts = rows.groupBy("page", "label").agg(F.min("position").alias("_first"), F.array_join(ordered, separator).alias("_text"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("_first", F.concat(F.lit("["), "label", F.lit("]\n"), "_text").alias("block")))), lambda x: x["block"])
    return parts.groupBy("page").agg(F.concat(F.array_join(blocks, "\n\n"), F.lit("\n")).alias("text"))


def page_text(regions: DataFrame, separator: str = "\n") -> DataFrame:
    """page and text: the texts of a page's regions (page, position, text) in order, empty ones left out, a line end last."""
    rows = regions.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    ordered = F.array_sort(F.collect_list(F.struct("position", "text")))
    return rows.groupBy("page").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["text"]), separator), F.lit("\n")).alias("text"))


def coco_annotation(kind: Column) -> Column:
    """A box (x1, y1, x2, y2) as JSON of a COCO annotation: x, y, width and height, area and outline."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    outline = F.array(*[F.col(c) for c in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")])
    return F.to_json(F.struct(kind.alias("category_id"), F.array("x1", "y1", w, h).alias("bbox"), (w * h).alias("area"), F.array(outline).alias("segmentation")))


def page_xml(pages: DataFrame) -> DataFrame:
    """page and a PAGE-like XML document of its lines."""
    rows = F.transform(F.split("text", "\n"), lambda t, i: F.struct(i.cast("string").alias("_id"), t.alias("TextEquiv")))
    return pages.select("page", F.to_xml(F.struct(F.struct(F.col("page").alias("_imageFilename"), rows.alias("TextLine")).alias("Page")), {"rowTag": "PcGts"}).alias("xml"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def append_evidence(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
