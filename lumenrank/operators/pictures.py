"""Decoded pictures (path, height, width, channels, data) of any size: one Arrow pass for each need, a picture in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

from lumenrank.functions import pixels as px
from lumenrank.functions.scoring import WEIGHTS
from lumenrank.functions.text import base64_text

METRICS = (*WEIGHTS, "composite")
NEEDED = ("height", "width", "channels", "data")


def _each(df: DataFrame, extra: list[StructField], f: Callable[[dict], dict | None], drop: tuple[str, ...] = ("data",)) -> DataFrame:
    """df with the values that f gives for each row, without the columns drop; a row for which f fails has nulls and says why in error."""
    kept = [c for c in df.columns if c not in drop]
    schema = StructType([*(x for x in df.schema.fields if x.name in kept), *extra, StructField("error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                row = {n: one.column(n)[0].as_py() for n in b.schema.names}
                try:
                    got, error = f(row), None
                except Exception as e:  # noqa: BLE001  whatever a broken picture raises is that picture's failure
                    got, error = {}, f"{type(e).__name__}: {e}"
                cols = [one.column(c) for c in kept] + [pa.array([got.get(x.name)], _arrow(x)) for x in extra]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([error], pa.string())], [*kept, *(x.name for x in extra), "error"])

    return df.mapInArrow(run, schema)


def _arrow(x: StructField) -> pa.DataType:
    of = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    name = x.dataType.simpleString()
    return pa.list_(of[name[6:-1]]) if name.startswith("array<") else of[name]


def _picture(row: dict) -> np.ndarray:
    return px.picture(row["data"], *(row[k] for k in NEEDED[:3]))


def technical(df: DataFrame, box: str | None = None) -> DataFrame:
    """df without data, with the seven metrics, their composite and error. box names a struct (x, y, w, h) of the subject, null where none is known; unreadable pictures have null metrics."""

    def f(row: dict) -> dict:
        b = row[box] if box else None
        return px.metrics(_picture(row), tuple(b[k] for k in "xywh") if b else None)

    return _each(df, [StructField(m, DoubleType()) for m in METRICS], f)


def features(df: DataFrame) -> DataFrame:
    """df without data, with what grouping compares: hash (four words), quick_sharpness, histogram, descriptors, and error."""

    def f(row: dict) -> dict:
        a = _picture(row)
        return {"hash": px.perceptual_hash(a), "quick_sharpness": px.quick_sharpness(a), "histogram": px.histogram(a), "descriptors": px.descriptors(a)}

    return _each(df, [StructField("hash", ArrayType(LongType())), StructField("quick_sharpness", DoubleType()), StructField("histogram", ArrayType(DoubleType())), StructField("descriptors", ArrayType(BinaryType()))], f)


def resized(df: DataFrame, limit: int = 1920, orientation: str | None = None) -> DataFrame:
    """df with pictures as they are meant to be seen, their longest edge at most limit; error where that fails. orientation names a column with the tag."""

    def f(row: dict) -> dict:
        a = px.oriented(_picture(row), row[orientation] if orientation else None)
        w, h = px.shrunk_size(a.shape[1], a.shape[0], limit)
        out = px.resampled(a, h, w)
        return {"height": h, "width": w, "channels": 3, "data": out.tobytes()}

    fields = [x for x in df.schema.fields if x.name in NEEDED]
    return _each(df, [StructField(n, next(x.dataType for x in fields if x.name == n)) for n in NEEDED], f, NEEDED)


def cropped(df: DataFrame, out_w: int, out_h: int, window: tuple[str, str, str, str] = ("crop_x", "crop_y", "crop_w", "crop_h")) -> DataFrame:
    """df without data, with hd (the window as a PNG file), image (the window at out_w by out_h), fallback and error.

    Where the window cannot be cut the whole picture is scaled instead and fallback is crop_failed; where that fails too, images are null.
    """

    def f(row: dict) -> dict:
        a = _picture(row)
        x, y, w, h = (row[c] for c in window)
        part, why = None, None
        if None not in (x, y, w, h) and w > 0 and h > 0 and 0 <= x and 0 <= y and x + w <= a.shape[1] and y + h <= a.shape[0]:
            part = a[y : y + h, x : x + w]
        else:
            part, why = a, "crop_failed"
        return {"hd": px.png(part), "image": px.png(px.resampled(part, out_h, out_w)), "fallback": why}

    return _each(df, [StructField("hd", BinaryType()), StructField("image", BinaryType()), StructField("fallback", StringType())], f)


def padded(df: DataFrame, out_w: int, out_h: int) -> DataFrame:
    """df without data, with image: the whole picture in a frame, as a PNG file."""
    return _each(df, [StructField("image", BinaryType())], lambda row: {"image": px.png(px.padded(_picture(row), out_w, out_h))})


def payload(df: DataFrame, max_edge: int = 1024) -> DataFrame:
    """df without data, with payload: the picture with its longest edge at most max_edge, as a PNG file in base 64, as model servers take it."""

    def f(row: dict) -> dict:
        a = _picture(row)
        w, h = px.shrunk_size(a.shape[1], a.shape[0], max_edge)
        return {"file": px.png(px.resampled(a, h, w))}

    return _each(df, [StructField("file", BinaryType())], f).withColumn("payload", base64_text(F.col("file"))).drop("file")
