"""Scans of the input tables and the three logical inputs derived from them.

* ratings (``R``): explicit ratings, one row per rating event, from
  ``orders ⋈ lineitem``; :func:`affinis.operators.candidates.latest_ratings`
  keeps the last rating per (user, item).
* items (``I``): the item catalogue, from ``part``.
* interactions (``E``): weighted actions, from ``events``.

All scans select only the columns they use so Parquet prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.session import table_path

EPOCH_NTZ = "timestamp_ntz'1970-01-01 00:00:00'"


def epoch_seconds(col: str) -> F.Column:
    """Whole epoch seconds of a wall-clock timestamp read as UTC.

    ``cast(ts as long)`` would shift a ``timestamp_ntz`` by the session zone.
    """
    return F.expr(f"timestampdiff(SECOND, {EPOCH_NTZ}, CAST({col} AS TIMESTAMP_NTZ))")


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*cols) if cols else df


# --------------------------------------------------------------------------
# ratings
# --------------------------------------------------------------------------

RATINGS_SCHEMA = T.StructType([
    T.StructField("userid", T.IntegerType()),
    T.StructField("itemid", T.IntegerType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("ts", T.LongType()),
])


def ratings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1/SRC11: the append-only rating log.

    ``rating`` is a half-star value 0.5 … 5.0 from the line quantity; the
    order key and line number give a total order for equal timestamps.
    """
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    lines = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber",
                       "l_partkey", "l_quantity", "l_shipdate")
    j = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return j.select(
        F.col("o_custkey").cast("int").alias("userid"),
        F.col("l_partkey").cast("int").alias("itemid"),
        (F.ceil(F.col("l_quantity") / 5) / 2).cast("double").alias("rating"),
        epoch_seconds("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("seq_major"),
        F.col("l_linenumber").cast("long").alias("seq_minor"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current ratings: the latest log row per (user, item) (WIN1)."""
    from affinis.operators.candidates import latest_ratings

    return latest_ratings(ratings_log(spark, sf_dir))


# --------------------------------------------------------------------------
# items
# --------------------------------------------------------------------------

# The declared item schema of the catalogue (JSON shape of an item schema:
# one id field and a list of typed features).  ``note`` is a text feature and
# must be left out of numeric feature vectors.
ITEM_SCHEMA_JSON = (
    '{"id": {"name": "itemid", "type": "int"},'
    ' "features": [{"name": "psize", "type": "double"},'
    ' {"name": "pretailprice", "type": "double"},'
    ' {"name": "note", "type": "text"}]}'
)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item catalogue: id, ``|``-joined labels, category, numeric features."""
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type",
                      "p_size", "p_retailprice")
    return part.select(
        F.col("p_partkey").cast("int").alias("itemid"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit("|")).alias("labels"),
        F.col("p_type").alias("category"),
        F.col("p_size").cast("double").alias("psize"),
        F.col("p_retailprice").cast("double").alias("pretailprice"),
        F.col("p_name").alias("note"),
    )


# --------------------------------------------------------------------------
# interactions
# --------------------------------------------------------------------------

def interactions_raw(spark: SparkSession, sf_dir: str, batch_size: int = 1000) -> DataFrame:
    """Raw weighted-action events (the wire shape, before validation).

    ``seq`` is the total order of the log; ``batch_id`` groups consecutive
    events into the request batches the all-or-nothing gate works on.
    """
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id",
                    "event_type", "props")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("item_id"),
        F.col("event_type").alias("action"),
        F.lit(None).cast("double").alias("rating"),
        epoch_seconds("ts").alias("ts"),
        F.floor(F.col("event_id") / batch_size).cast("long").alias("batch_id"),
    )


# The action weights registered for the ``events`` table.
# (``error`` is deliberately not registered, so those events are rejected.)
EVENT_ACTIONS = [("view", 1.0), ("click", 2.0), ("signup", 3.0), ("purchase", 5.0)]

ACTIONS_SCHEMA = "name string, weight double"


def actions_table(spark: SparkSession, rows=None) -> DataFrame:
    """The small action → weight dimension table, as literal rows of the plan."""
    rows = list(rows if rows is not None else EVENT_ACTIONS)
    if not rows:
        return spark.createDataFrame([], ACTIONS_SCHEMA)
    args = {f"n{i}": n for i, (n, _) in enumerate(rows)} | {f"w{i}": float(w) for i, (_, w) in enumerate(rows)}
    values = ", ".join(f"(:n{i}, :w{i})" for i in range(len(rows)))
    return spark.sql(f"SELECT * FROM VALUES {values} AS actions(name, weight)", args=args)
