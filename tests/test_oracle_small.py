"""Registered queries against their DuckDB oracle on sf0.001 (the driver's
gate runs all of them on sf0.01; ``AFFINIS_ALL_ORACLES=1`` runs all here)."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import duck, norm  # noqa: E402

SF = "/root/testdata/sf0.001"

REPRESENTATIVE = [
    "interactions_rejected", "batch_gate", "accepted_events", "pair_counts", "similarity_replay",
    "recs_item_item", "ratings_latest", "unrated_pairs", "popular_items_by_items",
    "train_test_split", "item_onehot", "hybrid_topk", "final_padded", "eval_weight_sweep",
    "r_precision", "stream_pair_counts",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("AFFINIS_ALL_ORACLES") else REPRESENTATIVE


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sp = entry.queries()[name](spark, SF).toPandas()
    dk = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    assert len(sp) == len(dk)
    assert norm(sp)[0] == norm(dk)[0]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "item_id", "score", "rank"]
    assert df.count() >= 0
