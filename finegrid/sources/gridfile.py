"""Fixed-layout grid files: little-endian float32, days x rows x columns, a code for missing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridLayout:
    rows: int
    cols: int
    ymin: float
    xmin: float
    res: float
    missing: float

    def bytes_of(self, days: int) -> int:
        return self.rows * self.cols * days * 4


# Published layouts (rain 0.25 degrees in mm per day, temperature 1 degree in deg C).
LAYOUTS = {
    "rain": GridLayout(rows=129, cols=135, ymin=6.5, xmin=66.5, res=0.25, missing=-999.0),
    "tmax": GridLayout(rows=31, cols=31, ymin=7.5, xmin=67.5, res=1.0, missing=99.9),
    "tmin": GridLayout(rows=31, cols=31, ymin=7.5, xmin=67.5, res=1.0, missing=99.9),
}


def days_in_year(year: int) -> int:
    return 366 if (year % 4 == 0 and year % 100 != 0) or year % 400 == 0 else 365


def decode(content: bytes, layout: GridLayout, days: int) -> np.ndarray:
    """Days x rows x columns with NaN for missing; a file of another size is an error."""
    if len(content) != layout.bytes_of(days):
        raise ValueError(f"grid file has {len(content)} bytes, {layout.bytes_of(days)} expected for {days} days")
    cube = np.frombuffer(content, dtype="<f4").reshape(days, layout.rows, layout.cols)
    return np.where(np.isclose(cube, layout.missing, atol=0.05), np.nan, cube)


def encode(cube: np.ndarray, layout: GridLayout) -> bytes:
    return np.where(np.isnan(cube), layout.missing, cube).astype("<f4").tobytes()


def read_grid_files(spark: SparkSession, path: str, layout: GridLayout, days_of) -> DataFrame:
    """Cells ``(file, day, i, j, value)`` of all files below ``path``; missing cells have a NULL value.

    One file is one task at most; it is decoded day by day, so a task holds a file
    of bytes and a single day of rows.  ``days_of(name)`` gives a file's day count.
    """
    ii, jj = (a.ravel().astype("int32") for a in np.indices((layout.rows, layout.cols)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = p.rsplit("/", 1)[-1]
                cube = decode(content.as_buffer().to_pybytes(), layout, days_of(name))
                for d, field in enumerate(cube):
                    v = field.ravel().astype("float64")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * v.size), pa.array(np.full(v.size, d, "int32")), pa.array(ii), pa.array(jj), pa.array(v, from_pandas=True)],
                        names=["file", "day", "i", "j", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, "file string, day int, i int, j int, value double")


def pack_grid_files(cells: DataFrame, layout: GridLayout, days_of) -> DataFrame:
    """``(file, content)`` from cells ``(file, day, i, j, value)``; every file has its full size.

    A group is one file, whose size is fixed by the layout (25 MB for a year of the finest).
    """
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["file"].iat[0]
        cube = np.full((days_of(name), layout.rows, layout.cols), np.nan)
        cube[pdf["day"], pdf["i"], pdf["j"]] = pdf["value"]
        return pd.DataFrame({"file": [name], "content": [encode(cube, layout)]})

    return cells.select("file", "day", "i", "j", "value").groupBy("file").applyInPandas(pack, "file string, content binary")


def save_files(files: DataFrame, folder: str) -> DataFrame:
    """Write each ``(file, content)`` below ``folder`` (any file system) and return name and size.

    A retried task writes the same bytes under the same name, so repeats are harmless.
    """
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in frames:
            for name, content in zip(pdf["file"], pdf["content"]):
                system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
                system.create_dir(root, recursive=True)
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield pd.DataFrame({"file": pdf["file"], "bytes": pdf["content"].map(len)})

    return files.mapInPandas(write, "file string, bytes long")


def cell_centre(layout: GridLayout):
    """Latitude and longitude of ``i, j`` as columns."""
    return F.lit(layout.ymin) + F.col("i") * layout.res, F.lit(layout.xmin) + F.col("j") * layout.res
