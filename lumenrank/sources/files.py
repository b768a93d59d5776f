"""Folders of pictures, reports and side files as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.functions import text
from lumenrank.functions.pixels import exif

REPORT_FILE = "selection_report.json"
#: What a report row holds; readers do not guess types from files of unknown origin.
REPORT = "rank bigint, filename string, final_score double, technical_composite double, total bigint, one_line string, output_cropped string, output_hd string, output_full string, uncertain boolean, reasons array<string>, burst struct<count: bigint, selected_by: string, members: array<string>>"


def _path(x: Column) -> Column:
    """One spelling of local paths, which readers spell differently."""
    return F.regexp_replace(x, "^file:/+", "file:///")


def pictures(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """(path, mtime, length[, content, sha256]) of the pictures right in a folder, by extension. Content is read only if asked for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).where(text.is_picture(F.col("path")))
    out = rows.select(_path(F.col("path")).alias("path"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "length", *(["content", F.sha2("content", 256).alias("sha256")] if with_content else []))
    return out


def rasters(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, channels, data) of the pictures that can be decoded; data is row by row, blue first."""
    rows = spark.read.format("image").option("dropInvalid", True).load(folder).where(text.is_picture(F.col("image.origin")))
    return rows.select(_path(F.col("image.origin")).alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(path, payload): content in base 64, as model servers take it. Without an imaging library pictures go as they are."""
    return pictures(spark, folder, with_content=True).select("path", text.base64_text(F.col("content")).alias("payload"))


def reports(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all reports below a folder, with folder; an old column "output" stands in for a missing output_cropped. Files that hold no JSON give no rows."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", REPORT_FILE).text(root, wholetext=True)
    rows = files.select(F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("folder"), F.explode(F.from_json("value", f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in _fields())}, output: string>>")).alias("r"))
    return rows.select("r.*", "folder").withColumn("output_cropped", F.coalesce("output_cropped", F.nullif("output", F.lit("")))).drop("output")


def _fields() -> list[str]:
    """The columns of REPORT, one by one."""
    out, depth, held = [], 0, ""
    for c in REPORT:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(held.strip())
            held = ""
        else:
            held += c
    return [*out, held.strip()]


def report_input(spark: SparkSession, root: str) -> DataFrame:
    """(folder, input): the input folder that the first ten lines of a Markdown report name."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    head = F.array_join(F.slice(F.split("value", "\n"), 1, 10), "\n")
    return rows.select(F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("folder"), F.nullif(F.regexp_extract(head, r"(?m)^- Input: `([^`]*)`", 1), F.lit("")).alias("input"))


def write_files(rows: DataFrame, folder: str) -> None:
    """Write rows (name, content) as files into a folder, each by the task that holds it; a repeated task writes the same again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(_uri(folder))
        fs.create_dir(root, recursive=True)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                    f.write(content)
        yield pa.RecordBatch.from_pydict({"n": pa.array([], pa.int64())})

    rows.select("name", F.col("content").cast("binary")).mapInArrow(run, "n long").collect()


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def write_report(rows: DataFrame, folder: str) -> None:
    """The report as one JSON list, ranks in order; the rows are few (the top n), so one file holds them."""
    keep = F.struct(*(F.col(x.split(" ", 1)[0]) for x in _fields()))
    one = rows.agg(F.array_sort(F.collect_list(keep)).alias("r")).select(F.lit(REPORT_FILE).alias("name"), F.to_json("r", {"ignoreNullFields": "false"}).alias("content"))
    write_files(one, folder)


def work(spark: SparkSession, folder: str) -> DataFrame | None:
    """The pictures that an earlier run has resized, none if there was no run."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{folder}/pictures")
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(WORK).parquet(f"{folder}/pictures") if there else None


WORK = "path string, mtime double, taken double, height int, width int, channels int, data binary"
_TAG_FIELDS = "make string, model string, lens string, focal double, f_number double, exposure double, iso long, orientation int, original string, modified string, subsecond string"


def tags(spark: SparkSession, folder: str) -> DataFrame:
    """(path, taken, orientation, summary) of the pictures right in a folder, from the tags in their files; null where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _TAG_FIELDS.split(", ")]
        kinds = {"string": (pa.string(), str), "double": (pa.float64(), float), "long": (pa.int64(), int), "int": (pa.int32(), int)}
        for b in batches:
            found = [exif(c or b"") for c in b.column(1).to_pylist()]
            cols = []
            for x in _TAG_FIELDS.split(", "):
                name, kind = x.split()
                arrow, make = kinds[kind]
                cols.append(pa.array([None if t.get(name) is None else make(t[name]) for t in found], arrow))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["path", *names])

    rows = pictures(spark, folder, with_content=True).select("path", "content").mapInArrow(run, f"path string, {_TAG_FIELDS}")
    stamp = F.coalesce("original", "modified")
    t = F.struct("make", "model", "lens", "focal", "f_number", "exposure", "iso", stamp.alias("taken"))
    return rows.withColumn("__t", t).select("path", exif_time(stamp, F.coalesce("subsecond", F.lit("0"))).alias("taken"), "orientation", F.nullif(exif_summary(F.col("__t")), F.lit("")).alias("summary"))


def exif_time(stamp, subsecond):
    """Seconds since the epoch of "YYYY:MM:DD hh:mm:ss" and a fraction as text; null if it is no time."""
    base = F.try_to_timestamp(stamp, F.lit("yyyy:MM:dd HH:mm:ss"))
    return F.unix_micros(base) / 1e6 + F.coalesce(F.concat(F.lit("0."), F.trim(subsecond)).try_cast("double"), F.lit(0.0))


def exif_summary(tags):
    """Camera, lens, focal length, aperture, shutter, speed and date as one line, of the tags that are there (a struct)."""
    make, model = F.trim(tags["make"]), F.trim(tags["model"])
    camera = F.when(F.lower(model).startswith(F.lower(make)), model).otherwise(F.concat_ws(" ", make, model))
    shutter = F.when(tags["exposure"] >= 1, F.format_string("%.1fs", tags["exposure"])).when(tags["exposure"] > 0, F.concat(F.lit("1/"), F.bround(1 / tags["exposure"], 0).cast("long").cast("string"), F.lit("s")))
    parts = [F.nullif(camera, F.lit("")), F.nullif(tags["lens"], F.lit("")), F.when(tags["focal"] > 0, F.concat(F.bround(tags["focal"], 0).cast("long").cast("string"), F.lit("mm"))), F.when(tags["f_number"] > 0, F.format_string("f/%.1f", tags["f_number"])), shutter, F.when(tags["iso"] > 0, F.concat(F.lit("ISO "), tags["iso"].cast("string"))), F.nullif(tags["taken"], F.lit(""))]
    return F.concat_ws(", ", *parts)
