import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

# Golden interactions G: (seq, user, item, action); weights hover 1, click 2,
# like 3, share 4, buy 5.
GOLDEN_ACTIONS = [("hover", 1.0), ("click", 2.0), ("like", 3.0), ("share", 4.0), ("buy", 5.0)]
GOLDEN_EVENTS = [
    (0, "u1", "i1", "buy"), (1, "u1", "i2", "like"), (2, "u1", "i4", "click"),
    (3, "u2", "i2", "share"), (4, "u2", "i3", "like"), (5, "u2", "i5", "hover"),
    (6, "u3", "i1", "click"), (7, "u3", "i4", "click"), (8, "u4", "i2", "like"),
    (9, "u4", "i3", "buy"), (10, "u4", "i5", "click"), (11, "u5", "i1", "share"),
    (12, "u5", "i2", "hover"), (13, "u5", "i4", "buy"),
]


@pytest.fixture(scope="session")
def spark():
    from affinis.session import local_session

    s = local_session("*", "affinis-tests", **{"spark.sql.shuffle.partitions": "8",
                                               "spark.driver.memory": "8g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def golden(spark):
    """Golden events with resolved weights (schema of resolved interactions)."""
    w = dict(GOLDEN_ACTIONS)
    rows = [(s, u, i, a, w[a]) for s, u, i, a in GOLDEN_EVENTS]
    return spark.createDataFrame(rows, "seq long, user_id string, item_id string, action string, weight double")
