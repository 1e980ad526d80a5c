"""Item feature vectors (FE1–FE5, FE9–FE11, SET2, SET3, AGG4–AGG5).

Vectors are ``array<double>`` for SQL; ``to_ml_vector`` converts at an
estimator's door.  Vocabularies (labels, categories) are dictionary tables
with a dense index, joined to the rows; one-hot and multi-hot rows are sparse
(the sorted indices), and only the dense form is as wide as the dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions.schema import ItemSchema

# Label separators and the "no label" marker of the movie
# catalogue format.
LABEL_SPLIT_PATTERN = "[|:]"
NO_LABEL = "(no genres listed)"


def feature_vector(items: DataFrame, schema: ItemSchema, out: str = "features") -> DataFrame:
    """FE1: ``(id, [numeric features in declaration order])`` as doubles."""
    cols = [F.col(n).cast("double") for n in schema.numeric_features()]
    return items.select(F.col(schema.id_name), F.array(*cols).alias(out))


def weighted_feature_vector(items: DataFrame, schema: ItemSchema, ratios: dict[str, float],
                            out: str = "features") -> DataFrame:
    """FE2: each numeric feature × its ratio (missing ratio → 1)."""
    cols = [F.col(n).cast("double") * F.lit(float(ratios.get(n, 1.0)))
            for n in schema.numeric_features()]
    return items.select(F.col(schema.id_name), F.array(*cols).alias(out))


def label_array(c: str) -> Column:
    """Labels of one item: split on ``|`` and ``:``, marker dropped."""
    return F.filter(F.split(F.col(c), LABEL_SPLIT_PATTERN),
                    lambda x: (F.length(x) > 0) & (x != F.lit(NO_LABEL)))


def label_vocabulary(items: DataFrame, labels_col: str = "labels") -> DataFrame:
    """SET2: distinct labels, sorted (one row per label)."""
    return (items.select(F.explode(label_array(labels_col)).alias("label"))
            .distinct().orderBy("label"))


def dictionary(values: DataFrame, col: str) -> DataFrame:
    """``col`` and its dense 0-based ``index`` by name, numbered by row ranges."""
    from affinis.operators.prefix import ranged, row_numbers

    order = [F.col(col)]
    d = row_numbers(ranged(values.select(col).distinct(), [], order), [], order, "index")
    return d.withColumn("index", (F.col("index") - 1).cast("int"))


def sparse_hot(pairs: DataFrame, words: DataFrame, id_col: str, col: str) -> DataFrame:
    """``(id, indices)``: the sorted dictionary indices of each id's values."""
    hit = pairs.select(id_col, col).distinct().join(words, col)
    return hit.groupBy(id_col).agg(F.array_sort(F.collect_list("index")).alias("indices"))


def _dense(hot: DataFrame, words: DataFrame, id_col: str, out: str) -> DataFrame:
    """``indices`` as 0/1 per entry of the dictionary."""
    none = F.array().cast("array<int>")
    d = hot.select(id_col, F.coalesce("indices", none).alias("_own"),
                   words.agg(F.count(F.lit(1)).cast("int")).scalar().alias("_size"))
    places = F.when(F.col("_size") > 0, F.sequence(F.lit(0), F.col("_size") - 1)).otherwise(none)
    return d.select(id_col, F.transform(places, lambda i: F.array_contains("_own", i).cast("int")).alias(out))


def one_hot_labels(items: DataFrame, id_col: str = "itemid", labels_col: str = "labels") -> DataFrame:
    """FE3: 0/1 per vocabulary label (vocabulary sorted) as ``array<int>``;
    one row per row of ``items``, whose ids are unique."""
    pairs = items.select(id_col, F.explode(label_array(labels_col)).alias("label"))
    words = dictionary(pairs, "label")
    d = items.select(id_col).join(sparse_hot(pairs, words, id_col, "label"), id_col, "left")
    return _dense(d, words, id_col, "onehot")


def category_index(items: DataFrame, cat_col: str = "category") -> DataFrame:
    """SET3: distinct categories with a dense 0-based index by name."""
    return dictionary(items.select(F.col(cat_col).alias("category")), "category")


def categories_per_item(pairs: DataFrame, id_col: str = "itemid", cat_col: str = "category") -> DataFrame:
    """AGG5: categories of each item as a sorted list."""
    return pairs.groupBy(id_col).agg(F.array_sort(F.collect_set(cat_col)).alias("categories"))


def multi_hot(pairs: DataFrame, id_col: str = "itemid", cat_col: str = "category") -> DataFrame:
    """FE5: multi-hot over all categories (sorted), absent categories 0."""
    pairs = pairs.select(id_col, cat_col)
    words = dictionary(pairs.where(F.col(cat_col).isNotNull()), cat_col)
    d = pairs.select(id_col).distinct().join(sparse_hot(pairs, words, id_col, cat_col), id_col, "left")
    return _dense(d, words, id_col, "multihot")


def item_dictionary(items: DataFrame, schema: ItemSchema) -> DataFrame:
    """FE9: per item a name → value map of its numeric features."""
    names = schema.numeric_features()
    m = F.map_from_arrays(F.array(*[F.lit(n) for n in names]),
                          F.array(*[F.col(n).cast("double") for n in names]))
    return items.select(F.col(schema.id_name), m.alias("feature_map"))


def vector_to_string(c: str) -> Column:
    """Arrays as comma-joined text (for exact comparisons and CSV)."""
    return F.concat_ws(",", F.transform(F.col(c), lambda x: x.cast("string")))


def to_ml_vector(c: str) -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.col(c))
