"""Files of clouds, maps, tables and manifests, and the sinks for results."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def pcd_ascii(spark: SparkSession, path: str) -> DataFrame:
    """`file, x, y, z, intensity` of text point clouds; lines that don't hold three numbers are skipped, a missing intensity is null."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split(F.trim("value"), r"\s+").alias("p"))
    number = lambda i: F.get("p", F.lit(i)).try_cast("double")
    out = lines.select("file", *[number(i).alias(a) for i, a in enumerate(("x", "y", "z", "intensity"))])
    return out.where("x is not null and y is not null and z is not null and not isnan(x) and not isnan(y) and not isnan(z)")


LAS_RANGE = 1_000_000


def _opened(path: str):
    """A file for reading from any place, by the scheme of its name."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return system.open_input_file(place)


def las(spark: SparkSession, path: str) -> DataFrame:
    """`file, point, x, y, z, label` of LAS point clouds (point formats 0 to 10), label being the classification.

    Headers are read first, then ranges of a million points, each a task's piece, so files may be of any size. Files whose points all have one class get label 0.
    """

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                with _opened(name) as f:
                    data = f.read(375)
                start, form, step = int.from_bytes(data[96:100], "little"), data[104] & 63, int.from_bytes(data[105:107], "little")
                count = int.from_bytes(data[107:111], "little") or int.from_bytes(data[247:255], "little")
                scale, offset = np.frombuffer(data, "<f8", 3, 131).tolist(), np.frombuffer(data, "<f8", 3, 155).tolist()
                first = np.arange(0, count, LAS_RANGE)
                out = pd.DataFrame({"file": name, "first": first, "n": np.minimum(LAS_RANGE, count - first), "start": start, "form": form, "step": step})
                yield out.assign(scale=[scale] * len(first), offset=[offset] * len(first))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                with _opened(row.file) as f:
                    f.seek(row.start + row.first * row.step)
                    data = f.read(row.n * row.step)
                place = 15 if row.form < 6 else 16
                raw = np.frombuffer(data, np.dtype({"names": ["x", "y", "z", "c"], "formats": ["<i4", "<i4", "<i4", "u1"], "offsets": [0, 4, 8, place], "itemsize": row.step}), row.n)
                label = (raw["c"] & 31 if row.form < 6 else raw["c"]).astype("int32")
                for a in range(0, row.n, 100_000):
                    q = raw[a : a + 100_000]
                    xyz = {c: q[c] * row.scale[i] + row.offset[i] for i, c in enumerate("xyz")}
                    yield pd.DataFrame({"file": row.file, "point": np.arange(row.first + a, row.first + a + len(q)), **xyz, "label": label[a : a + 100_000]})

    # Contents aren't read here, only names.
    names = spark.read.format("binaryFile").load(path).select("path")
    pieces = names.mapInPandas(ranges, "file string, first bigint, n bigint, start bigint, form int, step int, scale array<double>, offset array<double>").repartition("file", "first")
    points = pieces.mapInPandas(read, "file string, point bigint, x double, y double, z double, label int")
    several = points.groupBy("file").agg((F.min("label") < F.max("label")).alias("_several"))
    return points.join(several, "file").withColumn("label", F.when(F.col("_several"), F.col("label")).otherwise(F.lit(0))).drop("_several")


def raster(spark: SparkSession, path: str) -> DataFrame:
    """`file, row, col, value` of maps in .npy or .csv files; NaN and empty cells are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                m = np.load(io.BytesIO(bytes(content)), allow_pickle=False) if name.endswith(".npy") else pd.read_csv(io.BytesIO(bytes(content)), header=None).to_numpy(dtype=float)
                if m.ndim != 2:
                    raise ValueError(f"{name}: a map has two dimensions, not {m.ndim}")
                r, c = np.nonzero(~np.isnan(m.astype(float)))
                yield pd.DataFrame({"file": name, "row": r.astype("int32"), "col": c.astype("int32"), "value": m[r, c].astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, row int, col int, value double")


def table(spark: SparkSession, path: str, required: Sequence[str], schema: str | None = None) -> DataFrame:
    """A CSV with a header; an error names the required columns that are missing."""
    df = spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df


def manifest(spark: SparkSession, path: str, rows: str, *, every: int = 1, limit: int | None = None) -> DataFrame:
    """The records of the list `rows` in JSON documents, with `position`; every n-th of them, at most `limit` per document."""
    docs = spark.read.json(path, multiLine=True).select(F.posexplode(rows).alias("position", "_r"))
    kept = docs.where(F.pmod("position", F.lit(every)) == 0)
    if limit is not None:
        kept = kept.where(F.col("position") < every * limit)
    return kept.select("position", "_r.*")


def html_rows(pages: DataFrame, *, text: str = "html", zone_hours: int = 1) -> DataFrame:
    """`utc_us, value` of the rows of weather tables in HTML: a head cell `dd/mm/yyyy hh` in a fixed offset from UTC, and the fifth data cell.

    Rows with an unreadable date or number are left out.
    """
    # A row begins at its head cell; a cell ends at its closing tag, and what is left of other tags in it goes.
    rows = pages.select(F.explode(F.split(text, r"(?i)(?=<th\b)")).alias("r"))
    inner = lambda cell: F.trim(F.regexp_replace(F.regexp_replace(cell, r"(?is)^.*<t[hd]\b[^>]*>", ""), "<[^>]*>", " "))
    cells = rows.select(F.transform(F.split("r", r"(?i)</t[hd]\s*>"), inner).alias("c"))
    head = F.regexp_replace(F.get("c", F.lit(0)), r"\s+", " ")
    stamp = F.when(head.rlike(r"^\d{2}/\d{2}/\d{4} \d{2}$"), F.concat(head, F.lit(f" +0{zone_hours}:00")))
    at = F.unix_micros(F.try_to_timestamp(stamp, F.lit("dd/MM/yyyy HH XXX")))
    return cells.select(at.alias("utc_us"), F.get("c", F.lit(5)).try_cast("double").alias("value")).where("utc_us is not null and value is not null")


def write_csv(df: DataFrame, path: str, *, order: Sequence[str], digits: int = 3) -> None:
    """CSV in order of some columns, doubles rounded; null is empty. Files follow one another in order of their names."""
    rounded = [F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema]
    df.select(*rounded).orderBy(*order).write.mode("overwrite").csv(path, header=True)


def coloured(points: DataFrame, value: str) -> DataFrame:
    """Points with `r, g, b`: blue to red between the 5th and 95th percentile of a value."""
    ends = points.agg(F.percentile(value, F.array(F.lit(0.05), F.lit(0.95))).alias("_e"))
    t = F.least(F.greatest(F.coalesce(F.try_divide(F.col(value) - F.col("_e")[0], F.col("_e")[1] - F.col("_e")[0]), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    shade = lambda c: F.round(255 * c).cast("int")
    return points.crossJoin(F.broadcast(ends)).withColumns({"r": shade(t), "g": F.lit(0), "b": shade(1 - t)}).drop("_e")  # one row


def write_ply(points: DataFrame, folder: str, *, colours: bool = False) -> None:
    """A text PLY in parts: `head` holds the header with the number of vertices, `body` the lines; put together, in order, they are the file."""
    names = ["x", "y", "z", *(["r", "g", "b"] if colours else [])]
    body = points.select(F.concat_ws(" ", *[F.format_string("%.6f", c) if c in "xyz" else F.col(c).cast("string") for c in names]).alias("value"))
    body.write.mode("overwrite").text(f"{folder}/body")
    n = points.sparkSession.read.text(f"{folder}/body").count()
    kinds = {**dict.fromkeys("xyz", "float"), "r": "uchar red", "g": "uchar green", "b": "uchar blue"}
    lines = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property {kinds[c]}" + (f" {c}" if c in "xyz" else "") for c in names], "end_header"]
    points.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/head")


def write_ply_binary(points: DataFrame, path: str) -> int:
    """One binary PLY of x, y, z as 32-bit floats; gives the number of points. The file is one by its nature, so points stream through the driver batch by batch."""
    xyz = points.select(*[F.col(a).cast("float").alias(a) for a in "xyz"]).dropna()
    n, size = 0, 10
    # The number of points stands in the head, in a field wide enough for any.
    head = lambda k: f"ply\nformat binary_little_endian 1.0\nelement vertex {k:>{size}}\nproperty float x\nproperty float y\nproperty float z\nend_header\n".encode()

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": [len(b)], "body": [b[["x", "y", "z"]].to_numpy("<f4").tobytes()]})

    with open(path, "wb") as out:
        out.write(head(0))
        for row in xyz.mapInPandas(packed, "n bigint, body binary").toLocalIterator():
            n += row["n"]
            out.write(bytes(row["body"]))
        out.seek(0)
        out.write(head(n))
    return n


def write_pcd(points: DataFrame, folder: str, *, intensity: str = "intensity") -> None:
    """A text PCD in parts, as `write_ply`: `head` with the number of points, `body` with the lines."""
    number = lambda c: F.format_string("%.6f", c)
    points.select(F.concat_ws(" ", *[number(F.col(a)) for a in "xyz"], number(F.coalesce(F.col(intensity).cast("double"), F.lit(0.0)))).alias("value")).write.mode("overwrite").text(f"{folder}/body")
    n = points.sparkSession.read.text(f"{folder}/body").count()
    lines = ["# .PCD v0.7", "VERSION 0.7", "FIELDS x y z intensity", "SIZE 4 4 4 4", "TYPE F F F F", "COUNT 1 1 1 1", f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", "DATA ascii"]
    points.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/head")


def map_lines(cells: DataFrame, *, file: str, cols: int) -> DataFrame:
    """`file, row, line`: maps of `cols` columns as lines of text, values with three digits, cells that are missing empty. A line is one row of one map."""
    held = cells.groupBy(file, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    value = lambda c: F.try_element_at("m", c)
    shown = F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.when(value(c).isNotNull(), F.format_string("%.3f", value(c))).otherwise(F.lit("")))
    return held.select(file, "row", F.array_join(shown, ",").alias("line"))


def write_map(cells: DataFrame, path: str, *, file: str, cols: int) -> None:
    """Maps as text, a folder per map; lines are in order of rows within and across its files."""
    lines = map_lines(cells, file=file, cols=cols)
    lines.repartitionByRange(F.col(file), F.col("row")).sortWithinPartitions(file, "row").select(file, F.col("line").alias("value")).write.mode("overwrite").partitionBy(file).text(path)


def write_bundle(columns: DataFrame, path: str, **scalars: object) -> None:
    """Columns as Parquet, and beside them one row of scalars."""
    columns.write.mode("overwrite").parquet(f"{path}/columns")
    columns.sparkSession.createDataFrame([tuple(scalars.values())], list(scalars)).coalesce(1).write.mode("overwrite").parquet(f"{path}/scalars")


def bundle(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/columns"), spark.read.parquet(f"{path}/scalars").first().asDict()


def image_folder(spark: SparkSession, path: str) -> DataFrame:
    """`path, ordinal, length, modified` of a folder's files in the order of the last number in their names, those without one behind, then by name. Contents aren't read."""
    from pyspark.sql import Window

    found = spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    number = F.regexp_extract("path", r"(\d+)[^0-9/]*$", 1).try_cast("bigint")
    # One folder of one recording.
    order = Window.partitionBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1)).orderBy(number.isNull(), number, "path")
    return found.withColumn("ordinal", F.row_number().over(order) - 1)


def documents(df: DataFrame, path: str, *, schema: str, made_by: str) -> None:
    """One JSON document per row, with the name of its schema and what made it."""
    df.select(F.lit(schema).alias("schema"), F.lit(made_by).alias("generated_by"), "*").write.mode("overwrite").json(path)


def surfaces(planes: DataFrame) -> DataFrame:
    """`document`: planes as JSON with polygon, role and surface type by tilt: floor, ceiling or wall."""
    up = F.abs(F.get("normal", F.lit(2)))
    kind = F.when(up > 0.7, F.when(F.get("center_3d", F.lit(2)) > F.get("centroid_3d", F.lit(2)), "ceiling").otherwise("floor")).otherwise("wall")
    return planes.select(F.to_json(F.struct(F.lit("surface/v1").alias("schema"), F.col("id"), kind.alias("surface_type"), F.lit("envelope").alias("role"), F.col("corners_3d").alias("polygon"))).alias("document"))
