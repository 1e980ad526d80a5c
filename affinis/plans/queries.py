"""Registry of named queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query reads the given tables (through ``sources.tables``) and runs the
library's operators over all of their rows.  Doubles derived by division or
square roots are rounded to 6 places at the very end (never before ranking).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.functions import columns as cols
from affinis.functions import features as feats
from affinis.functions.schema import ItemSchema, decode_items
from affinis.operators import baselines as base
from affinis.operators import candidates as cand
from affinis.operators import clusters
from affinis.operators import evaluate as ev
from affinis.operators import hybrid as hyb
from affinis.operators import ingest
from affinis.operators import joins
from affinis.operators import linear
from affinis.operators import models
from affinis.operators import popular as pop
from affinis.operators import similarity as sim
from affinis.operators import topk
from affinis.operators import tuning
from affinis.params import Params
from affinis.session import shared_scratch, stored
from affinis.sources import files, sinks, tables, user_files
from affinis.sources.manifest import KeyedTable
from affinis.streaming import learner as stream
from affinis.streaming import store

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


# ------------------------------------------------------------ interactions (E)

def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables.interactions_raw(spark, sf_dir)
    return ingest.resolve_weights(raw, tables.actions_table(spark))


def _learner(spark: SparkSession, sf_dir: str, mode: str, params: Params = Params()) -> dict:
    return sim.run(ingest.valid(_resolved(spark, sf_dir)), mode, params)


@register("interactions_resolved")
def q_interactions_resolved(spark, sf_dir):
    return ingest.valid(_resolved(spark, sf_dir)).select(
        "seq", "user_id", "item_id", "weight", "ts", "batch_id")


@register("interactions_rejected")
def q_interactions_rejected(spark, sf_dir):
    return ingest.rejected(_resolved(spark, sf_dir)).select(
        "seq", "user_id", "item_id", "action", "reason")


@register("batch_gate")
def q_batch_gate(spark, sf_dir):
    raw = tables.interactions_raw(spark, sf_dir).drop("batch_id")
    raw = ingest.batch_ids(raw, "seq", 2)
    res = ingest.resolve_weights(raw, tables.actions_table(spark))
    return ingest.batch_gate(res).select("seq", "user_id", "item_id", "weight", "batch_id")


@register("accepted_events")
def q_accepted_events(spark, sf_dir):
    acc = ingest.accepted_events(ingest.valid(_resolved(spark, sf_dir)))
    return acc.select("seq", "user_id", "item_id", "weight", "prev_weight", "delta")


@register("item_counts")
def q_item_counts(spark, sf_dir):
    return _learner(spark, sf_dir, "exact")["counts"]


@register("pair_counts")
def q_pair_counts(spark, sf_dir):
    return _learner(spark, sf_dir, "exact")["pairs"]


@register("similarity_exact")
def q_similarity_exact(spark, sf_dir):
    s = _learner(spark, sf_dir, "exact")["similarity"]
    return s.select("item_a", "item_b", "pair_count", r6("similarity"))


@register("similarity_replay")
def q_similarity_replay(spark, sf_dir):
    s = _learner(spark, sf_dir, "replay")["similarity"]
    return s.select("item_a", "item_b", "pair_count", r6("similarity"))


@register("neighbours_topk")
def q_neighbours_topk(spark, sf_dir):
    n = _learner(spark, sf_dir, "exact")["neighbours"]
    return n.select("item_id", "other_id", r6("similarity"), "rank")


@register("neighbours_replay")
def q_neighbours_replay(spark, sf_dir):
    n = _learner(spark, sf_dir, "replay")["neighbours"]
    return n.select("item_id", "other_id", r6("similarity"), "rank")


@register("similar_items")
def q_similar_items(spark, sf_dir):
    n = sim.similar_items(_learner(spark, sf_dir, "exact")["neighbours"])
    return n.select("item_id", "other_id", r6("similarity"), "rank")


@register("recs_item_item")
def q_recs_item_item(spark, sf_dir):
    out = _learner(spark, sf_dir, "exact")
    return sim.recommend(out["state"], out["neighbours"]).select(
        "user_id", "item_id", r6("score"), "rank")


@register("recs_item_item_replay")
def q_recs_item_item_replay(spark, sf_dir):
    out = _learner(spark, sf_dir, "replay")
    return sim.recommend(out["state"], out["neighbours"]).select(
        "user_id", "item_id", r6("score"), "rank")


# ----------------------------------------------------------------- ratings (R)

RECENCY_SECONDS = 30 * 86400   # "active users": rated within 30 days of as_of
LAST_N_ROWS = 1000             # FLT3: users of the last 1000 rating rows


def _ratings(spark, sf_dir) -> DataFrame:
    """The current ratings: a plan, never a session-wide cache, so that rows
    appended to the log are seen by the next query."""
    return tables.ratings(spark, sf_dir)


def _ratings_once(spark, sf_dir) -> DataFrame:
    """The current ratings written once for the several jobs of one query."""
    return stored(_ratings(spark, sf_dir), "ratings")


def as_of(ratings: DataFrame):
    """The reference time of a run: the newest rating (a scalar subquery)."""
    return ratings.select(F.max("ts")).scalar()


def _active(ratings: DataFrame) -> DataFrame:
    return cand.active_users(ratings, as_of(ratings), RECENCY_SECONDS)


@register("ratings_latest")
def q_ratings_latest(spark, sf_dir):
    return _ratings(spark, sf_dir).select("userid", "itemid", "rating", "ts")


@register("ratings_keyed")
def q_ratings_keyed(spark, sf_dir):
    r = _ratings(spark, sf_dir)
    return r.select("userid", "itemid", cols.composite_key("userid", "itemid").alias("rkey"),
                    cols.half_stars_to_ten("rating").alias("rating10"))


@register("ratings_after")
def q_ratings_after(spark, sf_dir):
    r = _ratings(spark, sf_dir)
    return cand.ratings_after(r, as_of(r) - 7 * 86400).select("userid", "itemid", "rating", "ts")


@register("active_users")
def q_active_users(spark, sf_dir):
    return _active(_ratings(spark, sf_dir))


@register("last_n_users")
def q_last_n_users(spark, sf_dir):
    return cand.last_n_users(_ratings(spark, sf_dir), LAST_N_ROWS)


@register("all_users")
def q_all_users(spark, sf_dir):
    return cand.all_users(_ratings(spark, sf_dir))


@register("rated_items")
def q_rated_items(spark, sf_dir):
    return cand.rated_items(_ratings(spark, sf_dir))


@register("catalogue_items")
def q_catalogue_items(spark, sf_dir):
    return cand.catalogue_items(tables.items(spark, sf_dir))


def _event_pairs(spark, sf_dir) -> DataFrame:
    """The (user, item) pairs that the event log names, as given pairs."""
    ev_ = tables.interactions_raw(spark, sf_dir)
    return ev_.select(F.col("user_id").try_cast("int").alias("userid"), F.col("item_id").try_cast("int").alias("itemid")).distinct()


@register("unrated_pairs")
def q_unrated_pairs(spark, sf_dir):
    r = _ratings(spark, sf_dir)
    pairs = _event_pairs(spark, sf_dir).join(_active(r), "userid", "left_semi")
    return cand.unrated_of(pairs.join(cand.rated_items(r), "itemid", "left_semi"), r).select("userid", "itemid")


@register("unrated_pairs_catalogue")
def q_unrated_pairs_catalogue(spark, sf_dir):
    """Of all users' event pairs, inactive users' too, the unrated ones of the whole
    catalogue, items that nobody rated included."""
    r = _ratings(spark, sf_dir)
    its = tables.items(spark, sf_dir)
    return cand.unrated_of(_event_pairs(spark, sf_dir).join(
        cand.catalogue_items(its), "itemid", "left_semi"), r).select("userid", "itemid")


@register("item_stats")
def q_item_stats(spark, sf_dir):
    return pop.item_stats(_ratings(spark, sf_dir)).select("itemid", r6("mean_rating"), "n_ratings")


@register("popular_items")
def q_popular_items(spark, sf_dir):
    p = pop.popular_items(_ratings(spark, sf_dir), "ratings")
    return p.select("itemid", r6("mean_rating"), "n_ratings", r6("score"))


@register("popular_items_by_items")
def q_popular_items_by_items(spark, sf_dir):
    p = pop.popular_items(_ratings(spark, sf_dir), "items")
    return p.select("itemid", r6("mean_rating"), "n_ratings", r6("score"))


@register("train_test_split")
def q_train_test_split(spark, sf_dir):
    return cand.ordered_split(_ratings(spark, sf_dir), Params().train_fraction).select(
        "userid", "itemid", "rating", "ts", "split")


@register("hash_split")
def q_hash_split(spark, sf_dir):
    return cand.hash_split(_ratings(spark, sf_dir), 80).select("userid", "itemid", "split")


# ------------------------------------------------------------------- items (I)

def _items(spark, sf_dir):
    return tables.items(spark, sf_dir)


def _schema():
    return ItemSchema.parse(tables.ITEM_SCHEMA_JSON)


# Feature ratios of the item schema.
FEATURE_RATIOS = {"psize": 2.0, "pretailprice": 0.1}


@register("item_features")
def q_item_features(spark, sf_dir):
    v = feats.feature_vector(_items(spark, sf_dir), _schema())
    return v.select("itemid", feats.vector_to_string("features").alias("features"))


@register("item_features_weighted")
def q_item_features_weighted(spark, sf_dir):
    v = feats.weighted_feature_vector(_items(spark, sf_dir), _schema(), FEATURE_RATIOS)
    return v.select("itemid", feats.vector_to_string("features").alias("features"))


@register("item_onehot")
def q_item_onehot(spark, sf_dir):
    v = feats.one_hot_labels(_items(spark, sf_dir))
    return v.select("itemid", feats.vector_to_string("onehot").alias("onehot"))


@register("label_vocabulary")
def q_label_vocabulary(spark, sf_dir):
    return feats.label_vocabulary(_items(spark, sf_dir))


@register("category_index")
def q_category_index(spark, sf_dir):
    return feats.category_index(_items(spark, sf_dir))


@register("item_multihot")
def q_item_multihot(spark, sf_dir):
    v = feats.multi_hot(_items(spark, sf_dir).select("itemid", "category"))
    return v.select("itemid", feats.vector_to_string("multihot").alias("multihot"))


@register("item_categories")
def q_item_categories(spark, sf_dir):
    v = feats.categories_per_item(_items(spark, sf_dir).select("itemid", "category"))
    return v.select("itemid", F.concat_ws(",", "categories").alias("categories"))


@register("feature_names")
def q_feature_names(spark, sf_dir):
    ci = feats.category_index(_items(spark, sf_dir))
    return ci.select("category", cols.safe_feature_name("category").alias("safe_name"),
                     cols.category_feature_name("index").alias("feature_name"))


@register("brand_ids")
def q_brand_ids(spark, sf_dir):
    p = tables.read_table(spark, sf_dir, "part", "p_partkey", "p_brand")
    return p.select(F.col("p_partkey").cast("int").alias("itemid"),
                    cols.id_after_last("p_brand", "#").alias("brand_id"))


# How the order status letters of ``orders`` read as ERP states.
ORDER_STATES = {"O": "Sales Order", "F": "Done"}


@register("state_to_rating")
def q_state_to_rating(spark, sf_dir):
    o = tables.read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    st = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ORDER_STATES.items() for x in kv]),
                                 F.col("o_orderstatus")), F.col("o_orderstatus"))
    o = o.withColumn("state", st)
    return o.select("o_orderkey", F.col("o_custkey").cast("int").alias("userid"), "state",
                    cols.state_to_rating("state").alias("rating"))


# ------------------------------------------------- hybrid, serving, evaluation

PRICE_SCALE = 1000.0
MATES_PAGE = 16
NEWEST_ROWS = 50
HYBRID_WEIGHT = Params().hb_collaborative_weight
SERVE_N = 10


def _active_profiles(r):
    return cand.user_profiles(r, as_of(r), RECENCY_SECONDS)


def _hybrid_ranked(spark, sf_dir, n: int | None = None, users: DataFrame | None = None, lists: bool = False):
    """ML11 on the stand-in predictors: cf = the item's mean rating, cb = the
    user's mean + size / 50; both are defined for every candidate, so the
    inner join of the two sides keeps all of them.  ``n`` and ``users``
    restrict the work to what a consumer needs; ``lists``: the ids of a user in
    one row."""
    r = _ratings_once(spark, sf_dir)
    prof = _active_profiles(r).select("userid", "owned", "user_mean")
    if users is not None:
        prof = prof.join(users, "userid", "left_semi")
    item_side = (pop.item_stats(r).select("itemid", F.col("mean_rating").alias("item_mean"))
                 .join(_items(spark, sf_dir).select("itemid", "psize"), "itemid"))
    w, scale = HYBRID_WEIGHT, base.CONTENT_SCALE

    def score(user, item):  # columns: user_mean; item_mean, psize
        return hyb.blend_values(item[:, 0], user[:, 0] + item[:, 1] / scale, w)

    return r, topk.pruned_topk(
        prof, item_side, score, n or Params().hybrid_top_k,
        [F.lit(w), F.lit((1.0 - w) / scale)], [F.col("item_mean"), F.col("psize")],
        F.col("user_mean") * (1.0 - w), own=[F.col("user_mean")], lists=lists)


@register("hybrid_topk")
def q_hybrid_topk(spark, sf_dir):
    _, h = _hybrid_ranked(spark, sf_dir)
    # predictions are exact sums of halves and fiftieths: identical doubles in
    # any engine, and rounding them would hit half-way cases; kept raw
    return h.select("userid", "itemid", "prediction", F.col("rank").cast("int").alias("rank"))


@register("hybrid_lists")
def q_hybrid_lists(spark, sf_dir):
    _, h = _hybrid_ranked(spark, sf_dir, lists=True)
    return hyb.id_list_text(hyb.id_lists(h))


def _online_lists(spark, sf_dir):
    out = _learner(spark, sf_dir, "exact")
    rec = sim.recommend(out["state"], out["neighbours"]).select(
        F.col("user_id").try_cast("int").alias("userid"), F.col("item_id").try_cast("int").alias("itemid"), "rank")
    return hyb.id_lists(rec)


@register("serve_with_fallback")
def q_serve_with_fallback(spark, sf_dir):
    r, h = _hybrid_ranked(spark, sf_dir, SERVE_N, lists=True)
    stored = hyb.id_lists(h)
    online = _online_lists(spark, sf_dir)
    ev_users = tables.interactions_raw(spark, sf_dir).select(F.col("user_id").try_cast("int").alias("userid"))
    users = cand.all_users(r).unionByName(ev_users)
    s = hyb.serve(users, stored, online, SERVE_N)
    return s.select("userid", cols.join_id_list("recommended_ids").alias("recommended_ids"), "source")


def _popular_top(r, n):
    p = pop.popular_items(r, "ratings")
    return hyb.top_n(p, n, [F.col("score").desc(), F.col("itemid")]).select("itemid", "rank")


def _newest_top(r, n):
    first = r.groupBy("itemid").agg(F.min("ts").alias("first_ts"))
    return hyb.top_n(first, n, [F.col("first_ts").desc(), F.col("itemid")]).select("itemid", "rank")


@register("final_padded")
def q_final_padded(spark, sf_dir):
    r, h = _hybrid_ranked(spark, sf_dir, SERVE_N)
    lists = hyb.pad_lists(cand.all_users(r), h, _popular_top(r, SERVE_N), _newest_top(r, SERVE_N),
                          r, SERVE_N)
    return hyb.id_list_text(lists)


def _split_once(spark, sf_dir):
    """The ordered 70/30 split, written once for all readers of a query."""
    s = stored(cand.ordered_split(_ratings(spark, sf_dir), Params().train_fraction), "split")
    return s.filter(F.col("split") == "train").drop("split"), s.filter(F.col("split") == "test").drop("split")


def _stand_ins(spark, sf_dir, train, test):
    return base.item_mean(train, test), base.user_mean_content(train, _items(spark, sf_dir), test)


def _eval_inputs(spark, sf_dir):
    """Stand-in predictions of the test pairs from the train part."""
    train, test = _split_once(spark, sf_dir)
    return test, *_stand_ins(spark, sf_dir, train, test)


@register("eval_labels")
def q_eval_labels(spark, sf_dir):
    test, _, _ = _eval_inputs(spark, sf_dir)
    return ev.label(test, "rating").select("userid", "itemid", "rating", "label")


@register("eval_accuracy")
def q_eval_accuracy(spark, sf_dir):
    test, cf, cb = _eval_inputs(spark, sf_dir)
    a = ev.accuracy(test, hyb.blend(cf, cb, HYBRID_WEIGHT))
    return a.select(r6("accuracy"), "n_pairs")


@register("eval_weight_sweep")
def q_eval_weight_sweep(spark, sf_dir):
    test, cf, cb = _eval_inputs(spark, sf_dir)
    return ev.weight_sweep(test, cf, cb).select("weight", r6("accuracy"), "n_pairs", "best")


@register("pipeline_sweep")
def q_pipeline_sweep(spark, sf_dir):
    """ML14 per content pipeline: 19 weights each for three stand-ins, one of them
    with holes (JOI3 drops those pairs)."""
    train, test = _split_once(spark, sf_dir)
    cf, cb = _stand_ins(spark, sf_dir, train, test)
    items = _items(spark, sf_dir)
    pipelines = {"size": cb, "price": base.user_mean_content(train, items, test, "pretailprice", PRICE_SCALE),
                 "category": base.user_category_mean(train, items, test)}
    return tuning.pipeline_sweep(test, cf, pipelines).select("pipeline", "weight", r6("accuracy"), "n_pairs", "best")


@register("eval_precision")
def q_eval_precision(spark, sf_dir):
    test, cf, cb = _eval_inputs(spark, sf_dir)
    return ev.precision_above(test, hyb.blend(cf, cb, HYBRID_WEIGHT)).select(r6("precision"), "n_pairs")


@register("r_precision")
def q_r_precision(spark, sf_dir):
    test, cf, cb = _eval_inputs(spark, sf_dir)
    return ev.r_precision(test, hyb.blend(cf, cb, HYBRID_WEIGHT)).select(
        "userid", "n_pos", r6("r_precision"))


@register("mean_r_precision")
def q_mean_r_precision(spark, sf_dir):
    test, cf, cb = _eval_inputs(spark, sf_dir)
    rp = ev.r_precision(test, hyb.blend(cf, cb, HYBRID_WEIGHT))
    return ev.mean_r_precision(rp).select(r6("mean_r_precision"))


@register("model_comparison")
def q_model_comparison(spark, sf_dir):
    test, cf, cb = _eval_inputs(spark, sf_dir)
    fam = {"cf": cf, "cb": cb, "hybrid": hyb.blend(cf, cb, HYBRID_WEIGHT)}
    return ev.compare_families(test, fam).select("family", r6("mean_r_precision"))


# ------------------------------------------------------------------- models

def _features(spark, sf_dir):
    return feats.feature_vector(_items(spark, sf_dir), _schema())


def _n_features() -> int:
    return len(_schema().numeric_features())


def _model_candidates(spark, sf_dir, with_cf: bool, with_cb: bool, alpha: float | None = None):
    """Candidate rows enriched with what the trained models need: user
    factors and coefficients on the user side (one row per user), item
    factors and features on the broadcast item side."""
    r = _ratings_once(spark, sf_dir)
    p = Params()
    prof = _active_profiles(r).select("userid", "owned")
    items = cand.rated_items(r).join(_features(spark, sf_dir), "itemid")
    if with_cf:
        uf, vf = models.als_factors(models.fit_als(r, p))
        prof, items = prof.join(uf, "userid"), items.join(vf, "itemid")
    if with_cb:
        lab = models.labelled_examples(r, _features(spark, sf_dir))
        a = p.cb_elastic_net if alpha is None else alpha
        coefs = linear.fit_user_models(lab, _n_features(), p.cb_reg_param, a, p.cb_max_iter)
        prof = prof.join(coefs.select("userid", "intercept", "coef"), "userid")
    return prof, items


def _parts(name: str, n: int) -> list[F.Column]:
    return [F.col(name)[j] for j in range(n)]


def _cf_topk(prof, items, k):
    d = Params().cf_rank
    return topk.pruned_topk(prof, items, None, k, _parts("uf", d), _parts("vf", d))


def _cb_topk(prof, items, k, score=None):
    d = _n_features()
    return topk.pruned_topk(prof, items, score, k, _parts("coef", d), _parts("features", d), F.col("intercept"))


def _cb_col():
    return F.col("intercept") + cols.dot("coef", "features", _n_features())


@register("linear_scores")
def q_linear_scores(spark, sf_dir):
    """ML4 on a coefficient table derived from the data (intercept = the
    user's mean rating, coefficients = [n_ratings / 1000, 0.001]): the
    scoring expression ``intercept + coef · features`` over the active
    users' candidates, top 10 per user."""
    r = _ratings_once(spark, sf_dir)
    prof = _active_profiles(r).select(
        "userid", "owned", F.col("user_mean").alias("intercept"),
        F.array((F.col("n_ratings") / F.lit(1000.0)).cast("double"), F.lit(0.001)).alias("coef"))
    items = cand.rated_items(r).join(_features(spark, sf_dir), "itemid")
    return _cb_topk(prof, items, SERVE_N, _cb_col()).select(
        "userid", "itemid", "prediction", F.col("rank").cast("int").alias("rank"))


@register("als_recs")
def q_als_recs(spark, sf_dir):
    prof, items = _model_candidates(spark, sf_dir, True, False)
    return _cf_topk(prof, items, Params().hybrid_top_k)


@register("als_topk")
def q_als_topk(spark, sf_dir):
    r = _ratings_once(spark, sf_dir)
    model = models.fit_als(r)
    return hyb.rank_predictions(models.cf_topk(model, _active(r), r, SERVE_N), SERVE_N)


def _user_models(spark, sf_dir, r):
    lab = models.labelled_examples(r, _features(spark, sf_dir))
    p = Params()
    return linear.fit_user_models(lab, _n_features(), p.cb_reg_param, p.cb_elastic_net, p.cb_max_iter)


@register("user_models")
def q_user_models(spark, sf_dir):
    return _user_models(spark, sf_dir, _ratings(spark, sf_dir))


@register("content_recs")
def q_content_recs(spark, sf_dir):
    prof, items = _model_candidates(spark, sf_dir, False, True)
    return _cb_topk(prof, items, Params().hybrid_top_k)


@register("glm_recs")
def q_glm_recs(spark, sf_dir):
    prof, items = _model_candidates(spark, sf_dir, False, True, alpha=0.0)
    return _cb_topk(prof, items, Params().hybrid_top_k)


def _split_pairs(spark, sf_dir):
    """Train ratings and the test pairs to score."""
    train, test = _split_once(spark, sf_dir)
    return train, test.select("userid", "itemid")


@register("forest_scores")
def q_forest_scores(spark, sf_dir):
    r, pairs = _split_pairs(spark, sf_dir)
    return models.content_predictions("random_forest", r, _features(spark, sf_dir), pairs, _n_features())


@register("tree_scores")
def q_tree_scores(spark, sf_dir):
    r, pairs = _split_pairs(spark, sf_dir)
    return models.content_predictions("decision_tree", r, _features(spark, sf_dir), pairs, _n_features())


@register("hybrid_models")
def q_hybrid_models(spark, sf_dir):
    """ML11 with the trained models: ALS ⊕ per-user elastic net, top 1000.
    A candidate needs both a factor pair and a coefficient row (inner join)."""
    prof, items = _model_candidates(spark, sf_dir, True, True)
    return topk.pruned_topk(prof, items, None, Params().hybrid_top_k,
                            *models.blended_vectors(Params().cf_rank, _n_features(), HYBRID_WEIGHT))


@register("item_clusters")
def q_item_clusters(spark, sf_dir):
    assign, _ = models.cluster_items(_features(spark, sf_dir), Params().clusters_k, Params().clusters_seed)
    return models.cluster_sizes(assign)


@register("item_cluster_centres")
def q_item_cluster_centres(spark, sf_dir):
    """ML9: the centres of the item clusters with their sizes and costs."""
    _, centres = clusters.fit_clusters(_features(spark, sf_dir), Params().clusters_k, Params().clusters_seed)
    return centres.select("cluster", feats.vector_to_string("centre").alias("centre"), "n_items", "cost")


@register("cluster_mates")
def q_cluster_mates(spark, sf_dir):
    """AGG4 + SNK4: clusters given by the catalogue's sizes, stored in pages; the other
    items of the clusters of the ten most popular items, read back."""
    path = shared_scratch(spark, "cluster-lists")
    assign = _items(spark, sf_dir).select("itemid", F.col("psize").cast("int").alias("cluster"))
    clusters.write_clusters(assign, path, MATES_PAGE)
    got = clusters.read_mates(spark, path, _popular_top(_ratings(spark, sf_dir), SERVE_N))
    return got.select("itemid", "page", cols.join_id_list("similar_items").alias("similar_items"))


@register("item_features_indexed")
def q_item_features_indexed(spark, sf_dir):
    v = models.index_features(_features(spark, sf_dir))
    return v.select("itemid", feats.vector_to_string("indexed").alias("indexed"))


# ------------------------------------------------------------ sources / sinks

@register("libsvm_roundtrip")
def q_libsvm_roundtrip(spark, sf_dir):
    """SNK10 → SRC6: the catalogue as LIBSVM with label = item id, read back."""
    path = shared_scratch(spark, "libsvm")
    sinks.write_libsvm(_features(spark, sf_dir), path, label="itemid")
    back = files.read_libsvm(spark, path, _n_features())
    return back.select(F.col("label").cast("int").alias("itemid"),
                       feats.vector_to_string("features").alias("features"))


@register("ratings_csv_roundtrip")
def q_ratings_csv_roundtrip(spark, sf_dir):
    """SRC2 over a CSV export of the current ratings."""
    path = shared_scratch(spark, "ratings-csv")
    sinks.write_ratings_csv(_ratings(spark, sf_dir), path)
    return files.read_ratings_csv(spark, path, require_all=True)


@register("erp_forward_fill")
def q_erp_forward_fill(spark, sf_dir):
    """SRC7 + WIN4: order lines as an ERP export, the order's id on its first line only;
    read back and filled forward in file order."""
    path = shared_scratch(spark, "erp")
    li = tables.read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    first = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_returnflag")) == 1
    (li.withColumn("id", F.when(first, F.concat(F.lit("order_"), "l_orderkey")).otherwise(F.lit("")))
     .repartitionByRange("l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber", "l_returnflag")
     .select("id", F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("category"))
     .write.option("header", True).option("sep", ";").csv(path))
    read = files.read_erp_csv(spark, [path], "id string, line int, category string")
    filled = files.forward_fill(read, "id", ["_file"], "_line")
    return filled.select(cols.id_after_last("id").alias("orderid"), "line", "category")


@register("user_export")
def q_user_export(spark, sf_dir):
    """SNK7: the current ratings exported in files by user; those of the users of
    the newest ratings read back through the index."""
    path = shared_scratch(spark, "user-export")
    r = _ratings(spark, sf_dir)
    user_files.write_user_files(r.select("userid", "itemid", F.col("rating").alias("prediction")), path)
    return user_files.read_user_files(spark, path, cand.last_n_users(r, NEWEST_ROWS),
                                      "itemid int, prediction double")


@register("item_json_ingest")
def q_item_json_ingest(spark, sf_dir):
    """FE7 + SNK12: item rows as JSON documents decoded by the declared
    schema, last write per id."""
    sch = _schema()
    it = _items(spark, sf_dir)
    docs = it.select(F.to_json(F.struct("itemid", "psize", "pretailprice", "note")).alias("value"),
                     F.col("itemid").cast("long").alias("seq"))
    dec = decode_items(docs, sch)
    good = dec.filter(F.col("reason").isNull()).drop("reason", "value")
    return sinks.upsert_latest(good, ["itemid"], ["seq"]).select("itemid", "psize", "pretailprice", "note")


@register("item_upserts")
def q_item_upserts(spark, sf_dir):
    """SNK12: order lines as item updates, merged in two batches into a stored
    table; ids repeat within and across the batches, and a row of the second
    batch may be older than the stored one."""
    line = tables.read_table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate",
                             "l_orderkey", "l_linenumber")
    rows = line.select(F.col("l_partkey").cast("long").alias("itemid"), F.col("l_shipdate").cast("date").alias("day"),
                       F.col("l_orderkey").cast("long").alias("seq"), F.col("l_linenumber").cast("int").alias("line"),
                       F.col("l_quantity").cast("double").alias("quantity"),
                       F.col("l_extendedprice").cast("double").alias("price"))
    kept = KeyedTable(spark, shared_scratch(spark, "item-upserts"),
                      "itemid long, day date, seq long, line int, quantity double, price double",
                      ["itemid"], ["day", "seq", "line"])
    kept.merge(rows.where("line <= 2"))
    kept.merge(rows.where("line > 2 or line is null"))
    return kept.read().withColumn("day", F.col("day").cast("string"))


@register("actions_registered")
def q_actions_registered(spark, sf_dir):
    """SNK14: the event types seen in the log, registered when new (with
    weight 1) next to the existing action table."""
    existing = tables.actions_table(spark)
    seen = (tables.read_table(spark, sf_dir, "events", "event_type")
            .select(F.col("event_type").alias("name"), F.lit(1.0).alias("weight")))
    return existing.unionByName(sinks.register_new(existing, seen, "name"))


# ------------------------------------------------------------ batch & lookups

@register("batch_run")
def q_batch_run(spark, sf_dir):
    """ML18: the whole CF → CB → hybrid chain; returns the stored lists."""
    from affinis.plans.batch import run_batch

    log = tables.ratings_log(spark, sf_dir)
    as_of_value = log.select(F.max("ts")).first()[0]
    out = shared_scratch(spark, "batch")
    paths = run_batch(spark, log, _items(spark, sf_dir), _schema(), as_of_value, out,
                      Params().with_(hb_last_n_seconds=RECENCY_SECONDS))
    return spark.read.parquet(paths["lists"])


@register("item_lookup")
def q_item_lookup(spark, sf_dir):
    """JOI12: the items the event log refers to, looked up in the catalogue
    (ids missing there come back with ``found = false``)."""
    ids = (tables.interactions_raw(spark, sf_dir).select(F.col("item_id").try_cast("int").alias("itemid"))
           .distinct())
    it = _items(spark, sf_dir).select("itemid", "category", "psize")
    return joins.lookup(ids, it, "itemid")


@register("active_user_predictions")
def q_active_user_predictions(spark, sf_dir):
    """SRC5: stored hybrid predictions of a set of users (those of the last
    1000 ratings), as a semi join."""
    wanted = cand.last_n_users(_ratings(spark, sf_dir), LAST_N_ROWS)
    _, h = _hybrid_ranked(spark, sf_dir, users=wanted)
    return h.select(
        "userid", "itemid", "prediction", F.col("rank").cast("int").alias("rank"))


@register("stored_lists_top")
def q_stored_lists_top(spark, sf_dir):
    """PRJ12 + LIM3: stored ``1:2:3`` lists parsed back, first 10 ids."""
    _, h = _hybrid_ranked(spark, sf_dir, SERVE_N, lists=True)
    stored = hyb.id_list_text(hyb.id_lists(h))
    parsed = stored.select("userid", cols.parse_id_list("recommended_ids").alias("recommended_ids"))
    top = hyb.take(parsed, SERVE_N)
    return top.select("userid", F.size("recommended_ids").alias("n_ids"),
                      cols.join_id_list("recommended_ids").alias("recommended_ids"))


@register("recent_ratings")
def q_recent_ratings(spark, sf_dir):
    """FLT1: ratings of the last 30 days before as_of (strict)."""
    r = _ratings(spark, sf_dir)
    return cand.recent(r, as_of(r), RECENCY_SECONDS).select("userid", "itemid", "rating", "ts")


@register("model_family_comparison")
def q_model_family_comparison(spark, sf_dir):
    """ML15 with trained families: every content model and ALS fitted on the
    train part of the ordered split, compared by mean R-precision on the test
    pairs (all users, one plan per family)."""
    train, test = _split_once(spark, sf_dir)
    feats_ = _features(spark, sf_dir)
    fam = models.content_families(models.PIPELINES.values(), train, feats_, test, _n_features())
    fam["als"] = models.cf_predictions(models.fit_als(train), test)
    return ev.compare_families(test, fam).select("family", r6("mean_r_precision"))


@register("pipeline_sweep_trained")
def q_pipeline_sweep_trained(spark, sf_dir):
    """ML14 with trained models: ALS blended with each registered content model at
    every weight, all fitted on the train part and judged on the test pairs."""
    train, test = _split_once(spark, sf_dir)
    feats_ = _features(spark, sf_dir)
    pipelines = models.content_families(models.PIPELINES.values(), train, feats_, test, _n_features())
    cf = models.cf_predictions(models.fit_als(train), test)
    return tuning.pipeline_sweep(test, cf, pipelines).select("pipeline", "weight", r6("accuracy"), "n_pairs", "best")


@register("item_dictionary")
def q_item_dictionary(spark, sf_dir):
    """FE9: per item the feature name → value map, as (item, feature, value)."""
    d = feats.item_dictionary(_items(spark, sf_dir), _schema())
    return d.select("itemid", F.explode("feature_map").alias("feature", "value"))


@register("user_models_roundtrip")
def q_user_models_roundtrip(spark, sf_dir):
    """SNK11 / ML10: the per-user model table saved, reloaded and used to
    score the active users' candidates (top 10 each)."""
    path = shared_scratch(spark, "user-models")
    r = _ratings_once(spark, sf_dir)
    _user_models(spark, sf_dir, r).write.mode("overwrite").parquet(path)
    coefs = spark.read.parquet(path)
    prof = _active_profiles(r).select("userid", "owned").join(coefs.select("userid", "intercept", "coef"), "userid")
    items = cand.rated_items(r).join(_features(spark, sf_dir), "itemid")
    return _cb_topk(prof, items, SERVE_N)


@register("feature_table_csv")
def q_feature_table_csv(spark, sf_dir):
    """FE4: the one-hot label table written as CSV with a header (item id +
    one column per label), read back."""
    path = shared_scratch(spark, "features-csv")
    oh = feats.one_hot_labels(_items(spark, sf_dir))
    vocab = [r.label for r in feats.label_vocabulary(_items(spark, sf_dir)).collect()]
    wide = oh.select("itemid", *[F.col("onehot")[i].alias(v) for i, v in enumerate(vocab)])
    wide.write.mode("overwrite").option("header", True).csv(path)
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


@register("stream_active_users")
def q_stream_active_users(spark, sf_dir):
    """STR4: users with an event in the last day before the newest event."""
    ev_ = tables.interactions_raw(spark, sf_dir)
    return stream.active_from_log(ev_, ev_.select(F.max("ts")).scalar(), 86400)


# ---------------------------------------------------------------- streaming

def _stream_store(spark, sf_dir, **rescoring):
    return store.stream_to_store(spark, sf_dir, tables.actions_table(spark), "events.parquet", **rescoring)


@register("stream_deltas")
def q_stream_deltas(spark, sf_dir):
    """STR2: what the learner added to item and pair counts, batch by batch."""
    return _stream_store(spark, sf_dir).table("deltas")


@register("stream_rejected")
def q_stream_rejected(spark, sf_dir):
    """STR1: the quarantine sink of the streaming ingest (same rules as batch)."""
    _, quarantine = stream.stream_deltas(spark, sf_dir, tables.actions_table(spark), "events.parquet")
    return spark.read.parquet(quarantine).select("seq", "user_id", "item_id", "action", "reason")


@register("stream_item_counts")
def q_stream_item_counts(spark, sf_dir):
    return _stream_store(spark, sf_dir).counts()[0]


@register("stream_pair_counts")
def q_stream_pair_counts(spark, sf_dir):
    return _stream_store(spark, sf_dir).counts()[1]


@register("stream_similarity")
def q_stream_similarity(spark, sf_dir):
    """STR3: similarity read from the maintained store."""
    s = _stream_store(spark, sf_dir).similarity()
    return s.select("item_a", "item_b", "pair_count", r6("similarity"))


@register("stream_rescored")
def q_stream_rescored(spark, sf_dir):
    """STR4: the ten best items of each user scored again because a batch found
    them inside the window (the last day before the newest event)."""
    kept = _stream_store(spark, sf_dir, active_seconds=86400, rescore=SERVE_N)
    return kept.table("recs").select("user_id", "item_id", r6("score"), "rank", "as_of")


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
