"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.session import cut_lineage, fanout_partitions, shared_scratch, table_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Byte tables for whole UTF-8 texts.  Bytes above 0x7F are never separators.
LOWER_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
ITEM_BYTES = bytes(0x20 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F
                   else LOWER_BYTES[b] for b in range(256))

#: Characters that end an item word, and those that end a plain word.
ITEM_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_BREAK = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character kept; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def item_words(text: Column) -> Column:
    """Words of letters, digits and all characters above 0x7F, A-Z lower-cased."""
    return F.array_remove(F.split(lower_ascii(text), ITEM_BREAK), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the
    body names it: the optimizer may copy a column's expression, a lambda's
    variable it may not."""
    return F.get(F.transform(F.array(value), body), 0)


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text (null id: null)."""
    return F.crc32(doc_id.cast("string"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def smallest_hashes(rows: DataFrame, key: str, limit: int, n: int) -> DataFrame:
    """Of ``n`` rows those among which the ``limit`` smallest hashes of ``key``
    are, about twice as many: filtered in place, before a sort gathers them."""
    share = (2 * limit + 1000) / max(n, 1)
    return rows if share >= 1 else rows.where(F.xxhash64(key) <= int(share * 2**64) - 2**63)


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def map_rows(df: DataFrame, rows, schema: str) -> DataFrame:
    """``rows(batch as dict of python lists) -> dict of columns`` over Arrow
    batches, one output batch for each slice of input rows."""
    arrow = arrow_schema(df.sparkSession, schema)
    names = arrow.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                out = rows(batch.slice(at, 1024).to_pydict())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[n], arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    """The Arrow form of a schema without time columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: later steps start
    from the files, whichever executors are lost meanwhile."""
    path = shared_scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


__all__ = ["F", "arrow_schema", "crc_of_id", "cut_lineage", "fanout_partitions", "item_words",
           "let", "lower_ascii", "map_rows", "read_table", "shared_scratch", "smallest_hashes", "unused", "utf8", "written"]
