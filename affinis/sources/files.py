"""File readers (SRC2, SRC6, SRC7, SRC8) and ERP export cleaning.

Schemas are declared, never inferred.  Malformed lines are recognised by the
CSV parser itself (corrupt-record column) — no per-row Python casts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.functions import columns as cols
from affinis.session import stored

RATINGS_CSV_SCHEMA = "userid int, itemid int, rating double, timestamp string"
MOVIES_CSV_SCHEMA = "itemid int, title string, genres string"


def read_ratings_csv(spark: SparkSession, path: str | list[str], require_all: bool = False) -> DataFrame:
    """SRC2: the columns ``userId, itemId, rating, timestamp`` by their names
    in the header, in any order.  A line with too few or too many fields, or whose
    user, item or rating does not parse is dropped; an empty field is a null
    (kept, unless ``require_all`` — the uploader's variant).

    Fields are read as text and cast with ``try_cast``; the drop condition
    references every typed field, so it holds whatever columns a query reads
    (``DROPMALFORMED`` only checks the columns a query happens to parse).
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = {"userid", "itemid", "rating", "timestamp"} - {c.lower() for c in header}
    if missing:
        raise ValueError(f"the header lacks {sorted(missing)}")
    schema = ", ".join(f"`{c}` string" for c in [*header, "_broken"])
    raw = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_broken").option("columnPruning", False)
           .option("enforceSchema", False).csv(path))
    raw = raw.select(*[F.col(c).alias(c.lower()) for c in header], "_broken")
    typed = {"userid": "int", "itemid": "int", "rating": "double"}
    bad = F.col("_broken").isNotNull()
    out = []
    for c, t in typed.items():
        v = F.col(c).try_cast(t)
        bad = bad | (F.col(c).isNotNull() & (F.length(F.trim(F.col(c))) > 0) & v.isNull())
        out.append(v.alias(c))
    df = raw.filter(~bad).select(*out, F.col("timestamp"))
    if require_all:
        df = df.dropna(how="any")
    return df


def read_movies_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC8: ``movieId,title,genres`` (quoted titles may hold commas); PRJ13
    renames ``movieId`` to ``itemid`` through the declared schema."""
    return (spark.read.schema(MOVIES_CSV_SCHEMA).option("header", True)
            .option("quote", '"').option("escape", '"').csv(path)
            .withColumnRenamed("genres", "labels"))


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """SRC6: ``label, features`` (ML vector); features as ``array<double>``."""
    from pyspark.ml.functions import vector_to_array

    r = spark.read.format("libsvm")
    if num_features:
        r = r.option("numFeatures", num_features)
    df = r.load(path)
    return df.select("label", vector_to_array("features").alias("features"))


def numbered_lines(df: DataFrame) -> DataFrame:
    """Rows of a file scan with ``_file`` and ``_line``, the row's number in its file
    (from 0, header and blank lines not counted), however the file was split.

    Inside a split the rows come in file order; splits are ordered by where they
    begin in the file.  The rows are written once with split and place, so that a lost task
    cannot number them anew; a split's offset is the count of rows in the file's
    earlier splits (one row per split, never one per line)."""
    placed = stored(df.select("*", F.col("_metadata.file_path").alias("_file"),
                              F.col("_metadata.file_block_start").alias("_start"),
                              F.monotonically_increasing_id().alias("_at")), "lines")
    splits = placed.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    return (placed.join(offsets, ["_file", "_start"])
            .select(*df.columns, "_file", (F.col("_off") + F.col("_at") - F.col("_first")).alias("_line")))


def read_erp_csv(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """SRC7: ``;``-separated, ``"``-quoted, header, several yearly files
    unioned; each row keeps its file and its line number there."""
    return numbered_lines(spark.read.schema(schema).option("header", True).option("sep", ";")
                          .option("quote", '"').option("mode", "PERMISSIVE").csv(paths))


# Column layout of the ERP exports.
ERP_ORDERS_SCHEMA = "product string, partner string, state string"
ERP_PRODUCTS_SCHEMA = "id string, category string"


def erp_ratings(orders: DataFrame) -> DataFrame:
    """PRJ7 + PRJ8 + FLT7: ``userid, itemid, rating`` from ERP order lines;
    rows with an empty field or an unknown state go to ``reason``."""
    rating = cols.state_to_rating("state")
    out = orders.select(
        cols.id_after_last("partner").alias("userid"), cols.id_after_last("product").alias("itemid"),
        rating.alias("rating"), "state", "product", "partner")
    reason = (F.when(~cols.non_empty("product", "partner", "state"), F.lit("empty_field"))
              .when(F.col("userid").isNull() | F.col("itemid").isNull(), F.lit("bad_id"))
              .when(F.col("rating").isNull(), F.lit("unknown_state")))
    return out.withColumn("reason", reason)


#: Lines of a task of a forward fill, about; the tasks follow the lines.
FILL_LINES = 1 << 19


def forward_fill(df: DataFrame, col: str, partition: list[str], order: str,
                 bucket: int = 1 << 17, out: str | None = None) -> DataFrame:
    """WIN4: replace empty ``col`` by the last non-empty value before it in
    ``order`` within ``partition``.

    A window spans one bucket of ``order``.  What a bucket hands to the next is its
    last non-empty row: found by a maximum of ``order`` (a number, so that it is
    hashed and combined map-side, no line is sorted for it), one row a bucket."""
    full = F.length(F.coalesce(F.col(col), F.lit(""))) > 0
    keys = [*partition, "_bkt"]
    d = df.withColumn("_bkt", F.floor(F.col(order) / F.lit(bucket)).cast("long"))
    ends = d.where(full).groupBy(*keys).agg(F.max(order).alias(order))
    last = d.where(full).select(*keys, order, F.col(col).alias("_v")).join(ends, [*keys, order])
    last = last.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("o"), "_v")).alias("_e"))
    # a bucket without a value passes the earlier one on: every bucket has a row
    chain = d.select(*keys).distinct().join(last, keys, "left")
    before = Window.partitionBy(*partition).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    carried = chain.select(*keys, F.max("_e").over(before)["_v"].alias("_carried"))
    within = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    tasks = max(1, -(-df.count() // FILL_LINES))
    filled = (d.repartition(tasks, *keys)
              .withColumn("_in", F.last(F.when(full, F.col(col)), ignorenulls=True).over(within)))
    return (filled.join(carried, keys, "left").withColumn(out or col, F.coalesce("_in", "_carried"))
            .drop("_bkt", "_in", "_carried"))


def erp_products(products: DataFrame) -> DataFrame:
    """Product → category rows: rows without category dropped *before* the
    forward fill of empty ids (per file), ids made numeric."""
    p = products.filter(cols.non_empty("category"))
    p = forward_fill(p, "id", ["_file"], "_line")
    return p.select(cols.id_after_last("id").alias("itemid"), F.col("category"))
