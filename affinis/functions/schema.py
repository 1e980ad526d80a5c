"""Declared item schemas (FE7, FLT11).

An item schema is a small JSON declaration::

    {"id": {"name": "itemid", "type": "int"},
     "features": [{"name": "psize", "type": "double"}, ...]}

It is parsed once on the driver (it is configuration, not data) into a
``StructType``; the item rows themselves are decoded on the executors with
``from_json``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared type names and the Spark types they map to.
TYPE_NAMES = {
    "int": T.IntegerType(), "bigint": T.LongType(), "long": T.LongType(),
    "double": T.DoubleType(), "float": T.FloatType(), "text": T.StringType(),
    "string": T.StringType(), "boolean": T.BooleanType(),
}
# Only these feature types enter numeric feature vectors (FLT11).
NUMERIC_FEATURE_TYPES = ("double", "float")


@dataclass(frozen=True)
class ItemSchema:
    id_name: str
    id_type: str
    features: tuple[tuple[str, str], ...]

    @staticmethod
    def parse(declaration: str | dict) -> "ItemSchema":
        d = json.loads(declaration) if isinstance(declaration, str) else declaration
        feats = tuple((f["name"], f["type"].lower()) for f in d.get("features", []))
        for _, t in feats:
            if t not in TYPE_NAMES:
                raise ValueError(f"unsupported feature type {t!r}")
        return ItemSchema(d["id"]["name"], d["id"]["type"].lower(), feats)

    def struct(self) -> T.StructType:
        fields = [T.StructField(self.id_name, TYPE_NAMES[self.id_type], False)]
        fields += [T.StructField(n, TYPE_NAMES[t], True) for n, t in self.features]
        return T.StructType(fields)

    def numeric_features(self) -> list[str]:
        """FLT11: float / double features in declaration order."""
        return [n for n, t in self.features if t in NUMERIC_FEATURE_TYPES]


def decode_items(json_rows: DataFrame, schema: ItemSchema, value_col: str = "value") -> DataFrame:
    """FE7/FE8: decode item JSON rows with the declared types.

    Rows that do not parse (a value of the wrong type included), or lack the
    id, get ``reason``; the caller splits
    them off into a quarantine.  Numbers keep their declared type (the
    reference truncated them to int).
    """
    declared = schema.struct()
    with_rest = T.StructType([*declared.fields, T.StructField("_unparsed", T.StringType())])
    parsed = F.from_json(F.col(value_col), with_rest,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unparsed"})
    d = json_rows.withColumn("_item", parsed)
    cols = [F.col(f"_item.{f.name}").alias(f.name) for f in schema.struct().fields]
    reason = (F.when(F.col("_item").isNull() | F.col("_item._unparsed").isNotNull(), F.lit("unparsable"))
              .when(F.col(f"_item.{schema.id_name}").isNull(), F.lit("missing_id")))
    return d.select(*[c for c in json_rows.columns], *cols, reason.alias("reason")).drop("_item")


def apply_schema(df: DataFrame, schema: ItemSchema) -> DataFrame:
    """Cast an already tabular item frame to the declared schema."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.struct().fields])
