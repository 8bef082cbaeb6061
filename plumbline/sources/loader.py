"""Readers by suffix, with schema-first options; every reader gives a lazy Spark plan where Spark has a source."""

from __future__ import annotations

import codecs
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import DataLoadingError, DependencyError

FORMATS = {".csv": "csv", ".tsv": "tsv", ".txt": "csv", ".json": "json", ".jsonl": "jsonl", ".parquet": "parquet", ".orc": "orc", ".feather": "feather", ".arrow": "feather", ".xlsx": "excel", ".xls": "excel", ".h5": "hdf5", ".hdf5": "hdf5"}
SCHEMES = ("http://", "https://", "ftp://")


class DataLoader:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.readers: dict[str, Callable[..., DataFrame]] = {
            "csv": self.load_csv, "tsv": lambda p, **o: self.load_csv(p, sep="\t", **o), "json": self.load_json, "jsonl": lambda p, **o: self.load_json(p, multiline=False, **o), "parquet": self.load_parquet,
            "orc": lambda p, **o: self.spark.read.options(**o).orc(p), "feather": self.load_feather, "excel": self.load_excel, "hdf5": self.load_hdf5,
        }

    def format_of(self, path: str) -> str:
        suffix = Path(path.split("?")[0]).suffix.lower()
        if suffix == ".pkl" or suffix == ".pickle":
            raise DataLoadingError("pickled tables are not read: unpickling runs code", {"path": path}, ["save the table as Parquet"])
        if suffix not in FORMATS:
            raise DataLoadingError("unknown suffix", {"path": path, "suffix": suffix}, [f"one of {', '.join(FORMATS)}"])
        return FORMATS[suffix]

    def load(self, path: str | Path, format: str | None = None, validate: bool = True, **options) -> DataFrame:
        path = str(path)
        if path.startswith(SCHEMES):
            return self.load_url(path, format, **options)
        kind = format or self.format_of(path)
        if validate:
            self.validate(path)
        return self.readers[kind](path, **options)

    def _status(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.getFileStatus(p) if fs.exists(p) else None, fs, p

    def validate(self, path: str) -> None:
        """The path exists on its file system and, if a file, is not empty; folders are partitioned tables."""
        status, _, _ = self._status(path)
        if status is None:
            raise FileNotFoundError(path)
        if not status.isDirectory() and status.getLen() == 0:
            raise DataLoadingError("the file is empty", {"path": path})

    @staticmethod
    def detect_encoding(data: bytes) -> str:
        """By byte-order mark, then strict UTF-8, else Latin-1."""
        for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
            if data.startswith(mark):
                return name
        try:
            codecs.getincrementaldecoder("utf-8")("strict").decode(data)
            return "utf-8"
        except UnicodeDecodeError:
            return "iso-8859-1"

    def _peek(self, path: str, size: int = 10_000) -> bytes:
        rows = self.spark.read.format("binaryFile").load(path).selectExpr(f"substring(content, 1, {size}) AS head").limit(1).collect()
        return bytes(rows[0].head) if rows else b""

    def load_csv(self, path: str, schema=None, sep: str = ",", encoding: str | None = None, detect_encoding: bool = False, **options) -> DataFrame:
        """With a schema the file is read once; without one Spark infers types in a second pass."""
        encoding = encoding or (self.detect_encoding(self._peek(path)) if detect_encoding else "utf-8")
        reader = self.spark.read.options(header=True, sep=sep, encoding=encoding, nanValue="NaN", nullValue="", **options)
        return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)

    def load_json(self, path: str, schema=None, multiline: bool = True, **options) -> DataFrame:
        reader = self.spark.read.options(multiLine=multiline, **options)
        return (reader.schema(schema) if schema is not None else reader).json(path)

    def load_parquet(self, path: str, **options) -> DataFrame:
        return self.spark.read.options(**options).parquet(path)

    def load_feather(self, path: str, columns: list[str] | None = None) -> DataFrame:
        from pyarrow import feather

        return self.spark.createDataFrame(feather.read_table(path.removeprefix("file://"), columns=columns))

    def load_excel(self, path: str, sheet_name: str | int = 0, **options) -> DataFrame:
        import pandas as pd

        try:
            return self.spark.createDataFrame(pd.read_excel(path.removeprefix("file://"), sheet_name=sheet_name, **options))
        except ImportError as error:
            raise DependencyError("reading Excel files needs openpyxl", original=error) from error

    def excel_sheets(self, path: str) -> list[str]:
        import pandas as pd

        try:
            return pd.ExcelFile(path).sheet_names
        except ImportError as error:
            raise DependencyError("reading Excel files needs openpyxl", original=error) from error

    def load_hdf5(self, path: str, key: str | None = None, **options) -> DataFrame:
        import pandas as pd

        if not key:
            raise DataLoadingError("HDF5 files need a key", {"path": path})
        try:
            return self.spark.createDataFrame(pd.read_hdf(path, key, **options))
        except ImportError as error:
            raise DependencyError("reading HDF5 files needs pytables", original=error) from error

    def hdf5_keys(self, path: str) -> list[str]:
        import pandas as pd

        try:
            with pd.HDFStore(path, "r") as store:
                return list(store.keys())
        except ImportError as error:
            raise DependencyError("reading HDF5 files needs pytables", original=error) from error

    def load_url(self, url: str, format: str | None = None, **options) -> DataFrame:
        from pyspark import SparkFiles

        kind = format or next((f for s, f in FORMATS.items() if s in url.lower()), "csv")
        self.spark.sparkContext.addFile(url)
        return self.readers[kind]("file://" + SparkFiles.get(url.split("?")[0].rsplit("/", 1)[-1]), **options)

    def load_jdbc(self, url: str, table: str, **options) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()

    def load_multiple(self, paths: list[str | Path], concat: bool = True, **options) -> DataFrame | list[DataFrame]:
        """Rows of all files by column name, missing columns as null; or a list."""
        parts = [self.load(p, **options) for p in paths]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if concat else parts

    def preview(self, path: str | Path, n: int = 5, **options) -> list:
        return self.load(path, **options).limit(n).collect()

    def info(self, path: str | Path) -> dict:
        status, fs, p = self._status(str(path))
        if status is None:
            raise FileNotFoundError(path)
        size = fs.getContentSummary(p).getLength()
        kind = self.format_of(str(path))
        out = {"path": str(path), "format": kind, "size_bytes": size, "size_mb": size / 1e6}
        if kind in ("csv", "tsv"):
            out["estimated_rows"] = self.spark.read.text(str(path)).count() - 1
        elif kind in ("parquet", "orc"):
            out["estimated_rows"] = self.load(path).count()
        return out


def from_pandas(spark: SparkSession, pdf, partitions: int | None = None) -> DataFrame:
    df = spark.createDataFrame(pdf)
    return df.repartition(partitions) if partitions else df


def to_pandas(df: DataFrame, max_rows: int):
    """At most max_rows rows on the driver."""
    return df.limit(max_rows).toPandas()
