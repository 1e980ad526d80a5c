"""Deterministic predictors (no training).

They give exactly defined predictions, so the blend / rank / evaluation
logic can be checked against SQL without a fitted model:

* ``item_mean``: prediction = the item's mean rating (a collaborative
  stand-in: what "users like you" rated the item on average);
* ``user_mean_content``: prediction = the user's mean rating plus a content
  offset ``feature / scale`` of the item (a content stand-in);
* ``user_category_mean``: prediction = the user's mean rating of the item's
  category (a content stand-in with holes: none where the user has not rated
  that category).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The content offset is feature / CONTENT_SCALE.
CONTENT_SCALE = 50.0


def item_mean(train: DataFrame, pairs: DataFrame) -> DataFrame:
    m = train.groupBy("itemid").agg(F.avg("rating").alias("prediction"))
    return pairs.select("userid", "itemid").join(m, "itemid").select("userid", "itemid", "prediction")


def user_mean_content(train: DataFrame, items: DataFrame, pairs: DataFrame,
                      feature: str = "psize", scale: float = CONTENT_SCALE) -> DataFrame:
    um = train.groupBy("userid").agg(F.avg("rating").alias("_um"))
    it = items.select("itemid", F.col(feature).cast("double").alias("_f"))
    j = pairs.select("userid", "itemid").join(um, "userid").join(it, "itemid")
    return j.select("userid", "itemid", (F.col("_um") + F.col("_f") / F.lit(scale)).alias("prediction"))


def user_category_mean(train: DataFrame, items: DataFrame, pairs: DataFrame) -> DataFrame:
    it = items.select("itemid", "category")
    m = (train.join(it, "itemid").groupBy("userid", "category").agg(F.avg("rating").alias("prediction")))
    return (pairs.select("userid", "itemid").join(it, "itemid").join(m, ["userid", "category"])
            .select("userid", "itemid", "prediction"))
