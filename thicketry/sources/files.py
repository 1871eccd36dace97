"""Files in and out: image folders, split lists, caches, audits; equal writes are no-ops, different ones refused."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicketry.functions import fingerprints, keys
from thicketry.operators.relations import require_unique, same_bag


def scan_images(spark: SparkSession, roots: list[str], endings: tuple[str, ...] = keys.IMAGE_ENDINGS, content: bool = False) -> DataFrame:
    """(sample_key, subset, stem, path[, content]) of the image files of ``roots``; contents are read only if asked for.

    The ending test does not mind case. A folder named im, imgs or images names no subset; the one above does.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    files = files.where(keys.is_image("path", endings)).select("path", *(["content"] if content else []))
    files = files.withColumn("subset", keys.subset_of_path("path")).withColumn("stem", keys.stem("path"))
    return files.select(keys.sample_key("subset", "stem").alias("sample_key"), "subset", "stem", "path", *(["content"] if content else []))


def build_catalog(spark: SparkSession, roots: list[str], endings: tuple[str, ...] = keys.IMAGE_ENDINGS) -> DataFrame:
    """``scan_images`` in key order; raises if a key stands twice."""
    return require_unique(scan_images(spark, roots, endings), "sample_key").orderBy("sample_key")


def mask_dictionary(masks: DataFrame) -> DataFrame:
    """(mask_key, path): every mask under its full key, under the folder that holds its file, and under its bare stem if that stands once; the first path wins."""
    parts = F.filter(F.split(keys.slashes("path"), "/"), lambda p: p != "")
    full = masks.select(F.col("sample_key").alias("mask_key"), "path", F.lit(0).alias("_p"))
    folder = masks.select(keys.sample_key(F.get(parts, F.size(parts) - 2), "stem").alias("mask_key"), "path", F.lit(1).alias("_p")).where(F.size(parts) > 1)
    once = masks.groupBy("stem").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("path")).where("_n = 1")
    every = full.unionByName(folder).unionByName(once.select(F.col("stem").alias("mask_key"), "path", F.lit(2).alias("_p")))
    return every.groupBy("mask_key").agg(F.min(F.struct("_p", "path")).alias("m")).select("mask_key", "m.path")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(sample_key): the lines of a text list, blanks cut off, empty ones dropped."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\r$", "")).alias("sample_key")).where("sample_key <> ''")


def load_split(spark: SparkSession, path: str, catalog: DataFrame, count: int | None = None) -> DataFrame:
    """``read_split`` of a list that must be unique, in ascending order over its files, of ``count`` keys, all in the catalog; else an error that names all that is wrong.

    The order is checked line against line within a file, and first against last line between files
    in the order of their names; nothing is collected but one row a file.
    """
    from pyspark.sql import Window

    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("i"))
    lines = lines.select("f", "i", F.trim(F.regexp_replace("value", r"\r$", "")).alias("sample_key")).where("sample_key <> ''")
    wrong = []
    n, distinct = lines.agg(F.count(F.lit(1)), F.countDistinct("sample_key")).first()
    if n != distinct:
        wrong.append(f"{n - distinct} repeated keys")
    if count is not None and n != count:
        wrong.append(f"{n} keys in place of {count}")
    last = F.lag("sample_key").over(Window.partitionBy("f").orderBy("i"))
    ends = sorted(lines.groupBy("f").agg(F.min_by("sample_key", "i"), F.max_by("sample_key", "i")).collect())
    if not lines.withColumn("_l", last).where(F.col("_l") > F.col("sample_key")).isEmpty() or any(a[2] > b[1] for a, b in zip(ends, ends[1:])):
        wrong.append("not in order")
    unknown = lines.join(catalog.select("sample_key"), "sample_key", "left_anti").agg(F.count(F.lit(1)), F.min("sample_key")).first()
    if unknown[0]:
        wrong.append(f"{unknown[0]} unknown keys, the first {unknown[1]}")
    if wrong:
        raise ValueError(f"{path}: " + "; ".join(wrong))
    return lines.select("sample_key")


def read_split_of_either(split: DataFrame, column: str, catalog: DataFrame) -> DataFrame:
    """Keys, or row numbers of the key-ordered catalog written as text, as keys."""
    from thicketry.operators.relations import numbered

    n = numbered(catalog.select("sample_key").distinct(), "sample_key")
    s = split.select(F.col(column).cast("string").alias("_s"))
    number = F.col("_s").rlike(r"^\d+$")
    by_number = s.where(number).join(n, F.col("_s").cast("bigint") == F.col("position")).select("sample_key")
    return s.where(~number).select(F.col("_s").alias("sample_key")).unionByName(by_number)


def _rename(spark: SparkSession, a: str, b: str) -> bool:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(a)
    return p.getFileSystem(conf).rename(p, jvm.org.apache.hadoop.fs.Path(b))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def place(df: DataFrame, path: str, beside: str) -> None:
    """Writes a table under a name of its own in the folder ``beside`` and renames it to ``path``: a reader sees the whole or nothing."""
    spark = df.sparkSession
    tmp = f"{beside}/{uuid.uuid4().hex}"
    df.write.parquet(tmp)
    above = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    above.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(above)
    if not _rename(spark, tmp, path):
        raise OSError(f"cannot rename to {path}")


def write_once(df: DataFrame, path: str) -> str:
    """Writes a table under ``path``: ``written``; ``same`` if it holds the same rows already; else an error."""
    spark = df.sparkSession
    if exists(spark, path):
        if same_bag(df, spark.read.parquet(path)):
            return "same"
        raise FileExistsError(f"{path} holds other rows")
    place(df, path, f"{path}.writing")
    return "written"


def write_json_once(value, path: str) -> str:
    """The same for a small document of the driver, in canonical form."""
    text = fingerprints.canonical_json(value) + "\n"
    p = Path(path)
    if p.exists():
        if fingerprints.canonical_json(json.loads(p.read_text())) + "\n" == text:
            return "same"
        raise FileExistsError(f"{path} holds another value")
    tmp = p.with_name(f".{p.name}.{uuid.uuid4().hex}")
    tmp.write_text(text)
    os.replace(tmp, p)
    return "written"


def write_split(df: DataFrame, key: str, path: str) -> str:
    """Normalized, unique, sorted keys as one text file a range; returns their fingerprint. Raises on a repeated key, and if what is read again is not what was written."""
    rows = require_unique(df.select(keys.normalize_key(key).alias("sample_key")), "sample_key").orderBy("sample_key")
    rows.write.option("lineSep", "\n").text(path)
    saved = fingerprints.ordered_fingerprint(rows, "sample_key")
    if fingerprints.ordered_fingerprint(read_split(df.sparkSession, path), "sample_key") != saved:
        raise OSError(f"{path} holds other keys than were written")
    return saved


def write_audit(df: DataFrame, key: str, numbers: list[str], path: str, digits: int = 10) -> None:
    """CSV with a header in key order, numbers in fixed decimals, nulls empty."""
    cols = [F.when(F.col(c).isNotNull(), keys.fixed(c, digits)).alias(c) if c in numbers else F.col(c) for c in df.columns]
    df.orderBy(key).select(*cols).write.option("header", "true").option("emptyValue", "").csv(path)


def aligned_report(rows: list[dict], columns: list[str], digits: int = 3) -> str:
    """A small table of the driver as aligned text."""
    cells = [[f"{r[c]:.{digits}f}" if isinstance(r[c], float) else str(r[c]) for c in columns] for r in rows]
    width = [max(len(c), *(len(x[i]) for x in cells)) if cells else len(c) for i, c in enumerate(columns)]
    line = lambda x: " | ".join(v.ljust(w) for v, w in zip(x, width)).rstrip()
    return "\n".join([line(columns), "-+-".join("-" * w for w in width), *map(line, cells)]) + "\n"


def read_gray(files: DataFrame, key: str = "sample_key", content: str = "content") -> DataFrame:
    """(key, h, w, p): binary PGM (P5) images as row-major arrays of 0..1, of one or two bytes a cell, with comments in the head.

    Another format needs a decoder the caller brings; it raises here, as does a file whose cells are
    fewer or more than its head says.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, b in zip(pdf[key], pdf[content]):
                try:
                    rows.append((k, *_gray(b)))
                except ValueError as e:
                    raise ValueError(f"{k}: {e}") from e
            yield pd.DataFrame(rows, columns=[key, "h", "w", "p"])

    return files.select(key, content).mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, h int, w int, p array<float>")


def prepare_images(files: DataFrame, to_h: int, to_w: int, mean: float = 0.0, deviation: float = 1.0, key: str = "sample_key", content: str = "content") -> DataFrame:
    """(key, p): gray images of any size as bilinear maps of one size, less the mean, over the deviation; an Arrow batch at a time."""

    def run(batches):
        import numpy as np
        import pandas as pd

        from thicketry.operators.maps import bilinear

        for pdf in batches:
            rows = []
            for k, b in zip(pdf[key], pdf[content]):
                try:
                    h, w, p = _gray(b)
                except ValueError as e:
                    raise ValueError(f"{k}: {e}") from e
                rows.append((k, ((bilinear(np.reshape(p, (1, h, w)), to_h, to_w)[0].ravel() - mean) / deviation).tolist()))
            yield pd.DataFrame(rows, columns=[key, "p"])

    return files.select(key, content).mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, p array<double>")


def write_gray(maps: DataFrame, root: str, key: str = "sample_key", array: str = "p", h: str = "h", w: str = "w") -> int:
    """One binary PGM a map, at ``root``/key.pgm on a file system that all tasks see, written beside and renamed; returns their number.

    Values are clamped to 0..1 and stored in one byte; a key that leads out of ``root`` fails.
    """

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for k, p, y, x in zip(pdf[key], pdf[array], pdf[h], pdf[w]):
                if k.startswith("/") or ".." in k.split("/"):
                    raise ValueError(f"unsafe key {k}")
                cells = np.round(np.clip(np.nan_to_num(np.asarray(p, float)), 0, 1) * 255).astype(np.uint8)
                if cells.size != y * x:
                    raise ValueError(f"{k}: {cells.size} cells in place of {y} x {x}")
                to = Path(root) / f"{k}.pgm"
                to.parent.mkdir(parents=True, exist_ok=True)
                tmp = to.with_name(f".{to.name}.{uuid.uuid4().hex}")
                tmp.write_bytes(b"P5 %d %d 255\n" % (x, y) + cells.tobytes())
                os.replace(tmp, to)
            yield pd.DataFrame({"n": [len(pdf)]})

    return maps.select(key, array, h, w).mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _gray(b: bytes) -> tuple[int, int, list[float]]:
    """Height, width and cells of a P5 image; two-byte cells have the high byte first."""
    import re

    import numpy as np

    head = re.match(rb"P5" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 3 + rb"\s", b)
    if not head:
        raise ValueError("not a binary gray map")
    w, h, top = map(int, head.groups())
    if not 0 < top < 65536:
        raise ValueError(f"largest value {top}")
    v = np.frombuffer(b[head.end() :], ">u2" if top > 255 else np.uint8)
    if v.size != w * h:
        raise ValueError(f"{v.size} cells in place of {h} x {w}")
    return h, w, (v / top).astype(np.float32).tolist()
