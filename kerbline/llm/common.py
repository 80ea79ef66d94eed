"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import materialize, shared_path

__all__ = ["materialize", "shared_path"]  # of kerbline.sources, for the operators here

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words between ASCII white space, as a Java regular expression.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


#: Rows of keys that a join may broadcast (some 100 bytes each); a larger table is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """keys (written out already) with a broadcast hint if its counted rows are few, so that texts need no shuffle; else as it is."""
    return F.broadcast(keys) if keys.count() <= most else keys


#: Rows of an Arrow batch, where the session leaves Spark's default of 10,000: texts may be long, and buffers are kept.
BATCH_ROWS = 1024


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of at most BATCH_ROWS rows, unless the session sets another number."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], Sequence]],
    fields: Sequence[T.StructField],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add columns that Python computes from Arrow batches, one row out for each row in.

    make() is called once in each task and returns the function that turns a batch into one array for each new field.
    keep names the input columns to return (default: all). A new field replaces an input column of its name.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new and (keep is None or f.name in keep)]
    at = [df.columns.index(f.name) for f in kept]
    # Spark looks columns up by name on the way to Python, where a dot would mean a field
    plain = [f"column {i}" if "." in c or "`" in c else c for i, c in enumerate(df.columns)]
    out = T.StructType([*(T.StructField(plain[i], f.dataType, f.nullable) for i, f in zip(at, kept)), *fields])
    types = [f.type for f in to_arrow_schema(T.StructType(list(fields)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            cols = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(fn(b), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in at), *cols], out.names)

    made = in_arrow(df if plain == df.columns else df.toDF(*plain), run, out)
    return made if plain == df.columns else made.toDF(*(f.name for f in kept), *(f.name for f in fields))


def texts(batch: pa.RecordBatch, name: str = "text", step: int = 256) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column; only step of them are Python objects at a time."""
    column = batch.column(name).cast(pa.binary())
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def set_apart(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """df with columns named like one of names renamed, and the columns that give them back under their own names."""
    taken = {n.lower() for n in names}
    away = {c: f"{c} of the input" for c in df.columns if c.lower() in taken}
    return df.withColumnsRenamed(away), [F.col(f"`{away.get(c, c)}`").alias(c) for c in df.columns]


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id has the crc of the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def like(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])
