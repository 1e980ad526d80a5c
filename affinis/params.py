"""Job parameters.

The reference keeps its tuning values in a key/value store that the batch
runner reads at start-up.  Here they are one frozen dataclass passed to the
jobs; per-feature ratios are a two-column DataFrame (see
``functions.features.ratio_table``).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed values that must equal the reference's defaults for equal results.
DEFAULT_CF_RANK = 10
DEFAULT_CF_REG_PARAM = 0.2
DEFAULT_CF_MAX_ITER = 2
DEFAULT_HB_COLLABORATIVE_WEIGHT = 0.1
DEFAULT_HB_LAST_N_SECONDS = 86400
DEFAULT_HYBRID_TOP_K = 1000
DEFAULT_NEIGHBOURS = 10
DEFAULT_CB_MAX_ITER = 10
DEFAULT_CB_REG_PARAM = 0.3
DEFAULT_CB_ELASTIC_NET = 0.8
DEFAULT_CLUSTERS_K = 50
DEFAULT_CLUSTERS_SEED = 1
DEFAULT_POSITIVE_FRACTION = 0.4   # upper band: >= min + (1 - 0.4) * range
DEFAULT_NEGATIVE_FRACTION = 0.4   # lower band:  < min + 0.4 * range
DEFAULT_TRAIN_FRACTION = 0.7


@dataclass(frozen=True)
class Params:
    # collaborative filtering (ALS)
    cf_rank: int = DEFAULT_CF_RANK
    cf_reg_param: float = DEFAULT_CF_REG_PARAM
    cf_max_iter: int = DEFAULT_CF_MAX_ITER
    cf_seed: int = 42
    # content model (per-user elastic net)
    cb_max_iter: int = DEFAULT_CB_MAX_ITER
    cb_reg_param: float = DEFAULT_CB_REG_PARAM
    cb_elastic_net: float = DEFAULT_CB_ELASTIC_NET
    # hybrid
    hb_collaborative_weight: float = DEFAULT_HB_COLLABORATIVE_WEIGHT
    hb_last_n_seconds: int = DEFAULT_HB_LAST_N_SECONDS
    hybrid_top_k: int = DEFAULT_HYBRID_TOP_K
    # item-item
    neighbours: int = DEFAULT_NEIGHBOURS
    # skew control: one running-aggregate window partition never spans more
    # than this many consecutive ``seq`` values of one key ...
    seq_bucket: int = 1 << 20
    # ... and one user's item-pair block never holds more than this many
    # items per side; heavier users are split into several blocks.
    pair_block_items: int = 2048
    # broadcast only sides with a proven row bound below this
    # clustering
    clusters_k: int = DEFAULT_CLUSTERS_K
    clusters_seed: int = DEFAULT_CLUSTERS_SEED
    # evaluation
    positive_fraction: float = DEFAULT_POSITIVE_FRACTION
    negative_fraction: float = DEFAULT_NEGATIVE_FRACTION
    train_fraction: float = DEFAULT_TRAIN_FRACTION
    extra: dict = field(default_factory=dict)

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)
