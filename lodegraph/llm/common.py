"""What the operators of this subpackage share: reading, materialising, splitting texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of words of kind `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` stay (A-Z in lower case); all others become spaces.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodegraph-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodegraph/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and rereads it: lineage ends there, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def renamed(docs: DataFrame) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with plain names for all columns but text, so that none can clash with an operator's, and the way back.

    The way back gives the columns of docs with the text as it is then; where the text changed, measured
    says that n_chars is its new length."""
    names = {f"c{k}": x for k, x in enumerate(docs.columns)}
    quoted = lambda x: F.col("`" + x.replace("`", "``") + "`")
    own = docs.select(*(quoted(x).alias("text" if x == "text" else k) for k, x in names.items()))

    def back(df: DataFrame, measured: bool = False) -> DataFrame:
        def column(k: str, x: str) -> Column:
            if x == "n_chars" and measured:
                return F.length("text").cast(docs.schema[x].dataType)
            return F.col("text" if x == "text" else k)

        return df.select(*(column(k, x).alias(x) for k, x in names.items()))

    return own, back


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[list]], list[list]]], schema: str, chunk: int = 512) -> DataFrame:
    """Maps column lists to column lists, chunk rows at a time.  make() runs once a task, on the executor."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for i in range(0, batch.num_rows, chunk):
                part = batch.slice(i, chunk)
                got = f([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(got, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)
