"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from ..durable import shared_folder, written

#: ASCII white space: the six characters that separate words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Bytes up to which a table may be broadcast; beyond it Spark shuffles both sides.
BROADCAST_BYTES = 32 << 20
ARROW_ROWS = 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint into the folder that driver and executors share; the rows are counted on the way, for ``small_side``.

    The folder is the session's ``spark.checkpoint.dir``. Where none is set, a temporary
    one will do on one machine (as in tests); on a cluster it is an error.
    """
    shared_folder(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows")).checkpoint(eager=True)
    out._rows = seen.get["rows"]
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder of ``durable``: smaller than a checkpoint, and read by column."""
    return written(df)


def long_rows(df: DataFrame) -> DataFrame:
    """Bound what a Python worker holds: texts are long, so unless the session says otherwise an Arrow batch has ``ARROW_ROWS`` rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(ARROW_ROWS))
    return df


def _row_bytes(kind: DataType, value: Column) -> Column | int:
    """About how many bytes a value takes; a plain number where that is the same for all."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        each = _row_bytes(kind.elementType, F.lit(None).cast(kind.elementType))
        if isinstance(each, int):
            return F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)) * each + 16
        own = F.transform(value, lambda x: F.lit(0).cast("long") + _row_bytes(kind.elementType, x))
        return F.coalesce(F.aggregate(own, F.lit(16).cast("long"), lambda acc, x: acc + x), F.lit(16))
    if isinstance(kind, StructType):
        return sum((_row_bytes(f.dataType, value[f.name]) for f in kind), 8)
    return 8


def small_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (checkpointed first unless it is a checkpoint), with a broadcast hint if its measured size allows; otherwise the join is left to Spark."""
    if not hasattr(df, "_rows"):
        df = durable(df)
    size = _row_bytes(df.schema, F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    if isinstance(size, int):
        size *= df._rows
    elif 16 * df._rows <= max_bytes:
        size = df.agg(F.sum(size)).head()[0] or 0
    else:
        return df
    return F.broadcast(df) if size <= max_bytes else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; none for null."""
    return F.array_remove(F.split(text_or_empty(text), SPACE_RUN), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def without_spaces(text: Column) -> Column:
    return F.translate(text_or_empty(text), SPACES, "")


def keep_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """The frame as one struct column, so that internal names never clash with its own."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name))


def unpack(df: DataFrame, columns: list[str], added: dict[str, Column], name: str = "_row") -> DataFrame:
    """The original columns (those that clash with an added one go), then the added ones."""
    return df.select(*[F.col(name)[c].alias(c) for c in columns if c not in added], *[v.alias(k) for k, v in added.items()])
