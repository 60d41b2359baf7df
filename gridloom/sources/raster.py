"""Sources and sinks of images: tables of vectors, arrays, binary files, Parquet."""

from __future__ import annotations

import io
import os
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "image_id string, y int, px array<double>"


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package wherever they start."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors_as_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one image: vector y is row y."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.lit("embeddings").alias("image_id"), F.col("vec_id").cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("px"))


def from_arrays(spark: SparkSession, images: dict[str, np.ndarray]) -> DataFrame:
    """Lines of in-memory images; each must be two-dimensional, of whole numbers, floats or bools."""
    rows = []
    for name, image in images.items():
        image = np.asarray(image)
        if image.ndim != 2 or image.dtype.kind not in "iufb":
            raise ValueError(f"{name}: a single-channel image of numbers is needed")
        rows += [(name, y, row.tolist()) for y, row in enumerate(as_double(image))]
    return spark.createDataFrame(rows, LINES)


def as_double(image: np.ndarray) -> np.ndarray:
    """Whole numbers over their type's range as 0 to 1; bools and floats as they are."""
    if image.dtype.kind in "iu":
        kind = np.iinfo(image.dtype)
        low = 0 if image.dtype.kind == "u" else float(kind.min)
        return (image.astype(np.float64) - low) / (float(kind.max) - low)
    return image.astype(np.float64)


def decode(content: bytes) -> np.ndarray:
    """An image of a .npy file or a binary PGM."""
    if content[:6] == b"\x93NUMPY":
        return np.load(io.BytesIO(content), allow_pickle=False)
    if content[:2] == b"P5":
        fields, at = [], 2
        while len(fields) < 3:
            while content[at : at + 1].isspace():
                at += 1
            if content[at : at + 1] == b"#":
                at = content.index(b"\n", at)
                continue
            end = at
            while not content[end : end + 1].isspace():
                end += 1
            fields.append(int(content[at:end]))
            at = end
        width, height, top = fields
        kind = np.dtype(">u2" if top > 255 else "u1")
        image = np.frombuffer(content, kind, width * height, at + 1).reshape(height, width)
        return image.astype(np.uint16 if top > 255 else np.uint8)
    raise ValueError("neither NPY nor binary PGM")


def encode(image: np.ndarray, dtype: str = "u8") -> bytes:
    """A PGM for u8 and u16, else NPY; unsigned types are scaled and rounded half to even."""
    out = cast_output(image, dtype)
    if dtype in ("u8", "u16"):
        return f"P5\n{out.shape[1]} {out.shape[0]}\n{np.iinfo(out.dtype).max}\n".encode() + out.astype(out.dtype.newbyteorder(">")).tobytes()
    to = io.BytesIO()
    np.save(to, out)
    return to.getvalue()


def cast_output(image: np.ndarray, dtype: str) -> np.ndarray:
    kind = np.dtype({"u8": "u1", "u16": "u2", "u32": "u4", "f32": "f4", "f64": "f8"}[dtype])
    return np.rint(image * float(np.iinfo(kind).max)).astype(kind) if kind.kind == "u" else image.astype(kind)


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Lines of all images below a path; the file's name is the image's id. Files are decoded by the executors."""
    workers_find_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)

    def rows(batches: Iterable[pd.DataFrame]):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                image = as_double(decode(content))
                yield pd.DataFrame({"image_id": name.rsplit("/", 1)[-1], "y": np.arange(len(image), dtype=np.int32), "px": list(image)})

    return files.select("path", "content").mapInPandas(rows, LINES)


def write_images(lines: DataFrame, path: str) -> None:
    """One Parquet folder for each image."""
    lines.write.mode("overwrite").partitionBy("image_id").parquet(path)


def encoded_images(lines: DataFrame, dtype: str = "u8") -> DataFrame:
    """image_id, content: each image as a file's bytes. A task holds one image at a time."""
    workers_find_package(lines.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.stack(pdf.sort_values("y")["px"].to_numpy())
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "content": [encode(image, dtype)]})

    return lines.groupBy("image_id").applyInPandas(run, "image_id string, content binary")


def readable(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))
