"""What the operators of this subpackage share: the query registry, table access, columns and stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qacorpus.session import write_out

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL twin where SQL can say it."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is.  ``lower`` does just that where all bytes are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


_scopes: list[list[DataFrame]] = []


def staged(df: DataFrame, kind: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    out = write_out(df, f"llm-{kind}")
    for scope in _scopes[-1:]:
        scope.append(out)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of staged tables that nothing will read again."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


class scratch:
    """Collects what is staged inside, so that it can be deleted together: ``with scratch() as old: ...; old.clear()``.

    Only for steps whose results are written before ``clear`` is called; a result that is read later still needs its files.
    """

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def __enter__(self) -> scratch:
        _scopes.append(self.frames)
        return self

    def __exit__(self, *_) -> None:
        _scopes.remove(self.frames)

    def clear(self) -> None:
        discard(*self.frames)
        self.frames.clear()
