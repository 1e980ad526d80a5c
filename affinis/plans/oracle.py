"""Independent SQL definitions (DuckDB dialect) of the registered queries.

Each query is one ``WITH`` chain over the raw tables; the fragments below
re-derive the inputs (ratings R, items I, interactions E) from the tables
with plain SQL, so the oracle shares no code with the Spark plans.
"""

from __future__ import annotations

# ---------------------------------------------------------------- interactions
E_RAW = """e_raw AS (
  SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS user_id,
         json_extract_string(props, '$.k') AS item_id, event_type AS action,
         CAST(NULL AS DOUBLE) AS rating, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
         CAST(floor(event_id / 1000) AS BIGINT) AS batch_id
  FROM events)"""

ACTIONS = """actions AS (
  SELECT * FROM (VALUES ('view', 1.0::DOUBLE), ('click', 2.0::DOUBLE),
                        ('signup', 3.0::DOUBLE), ('purchase', 5.0::DOUBLE)) t(name, weight))"""

E_CHK = """e_chk AS (
  SELECT e.seq, e.user_id, e.item_id, e.action, e.rating, e.ts, e.batch_id,
         CASE WHEN e.action IS NOT NULL THEN a.weight ELSE e.rating END AS weight,
         CASE WHEN e.action IS NOT NULL AND e.rating IS NOT NULL THEN 'both_action_and_rating'
              WHEN e.action IS NULL AND e.rating IS NULL THEN 'no_action_no_rating'
              WHEN e.action IS NOT NULL AND a.name IS NULL THEN 'unknown_action'
              WHEN (CASE WHEN e.action IS NOT NULL THEN a.weight ELSE e.rating END) <= 0
                   THEN 'non_positive_weight'
         END AS reason
  FROM e_raw e LEFT JOIN actions a ON e.action = a.name)"""

E_OK = """e_ok AS (SELECT seq, user_id, item_id, weight, ts, batch_id FROM e_chk WHERE reason IS NULL)"""

ACC = """acc0 AS (
  SELECT *, coalesce(max(weight) OVER (PARTITION BY user_id, item_id ORDER BY seq
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS prev_weight
  FROM e_ok),
acc AS (SELECT seq, user_id, item_id, weight, prev_weight, weight - prev_weight AS delta
        FROM acc0 WHERE weight > prev_weight)"""

ST = """st AS (SELECT user_id, item_id, max(weight) AS w, max(seq) AS last_seq
             FROM acc GROUP BY user_id, item_id)"""

RECENT_E = """recent_e AS (SELECT DISTINCT user_id FROM e_ok WHERE ts > (SELECT max(ts) FROM e_ok) - 86400)"""

CNT = """cnt AS (SELECT item_id, sum(w) AS item_count FROM st GROUP BY item_id)"""

PC = """pc AS (
  SELECT a.item_id AS item_a, b.item_id AS item_b, sum(least(a.w, b.w)) AS pair_count,
         max(greatest(a.last_seq, b.last_seq)) AS last_touch,
         arg_max(CASE WHEN a.last_seq > b.last_seq THEN a.item_id ELSE b.item_id END,
                 greatest(a.last_seq, b.last_seq)) AS touch_item
  FROM st a JOIN st b ON a.user_id = b.user_id AND a.item_id < b.item_id
  GROUP BY a.item_id, b.item_id)"""

SIMX = """simx AS (
  SELECT pc.item_a, pc.item_b, pc.pair_count,
         pc.pair_count / (sqrt(ca.item_count) * sqrt(cb.item_count)) AS similarity
  FROM pc JOIN cnt ca ON ca.item_id = pc.item_a JOIN cnt cb ON cb.item_id = pc.item_b)"""

SIMR = """simr AS (
  SELECT item_a, item_b, pair_count,
         pair_count / (
           sqrt((SELECT sum(delta) FROM acc
                 WHERE acc.item_id = pc.touch_item AND acc.seq <= pc.last_touch))
         * sqrt((SELECT sum(delta) FROM acc
                 WHERE acc.item_id = CASE WHEN pc.touch_item = pc.item_a THEN pc.item_b ELSE pc.item_a END
                   AND acc.seq <= pc.last_touch))) AS similarity
  FROM pc)"""


def nb(sim: str, k: int = 10, name: str = "nbx") -> str:
    return f"""dir_{name} AS (
  SELECT item_a AS item_id, item_b AS other_id, similarity FROM {sim}
  UNION ALL SELECT item_b, item_a, similarity FROM {sim}),
{name} AS (
  SELECT * FROM (
    SELECT item_id, other_id, similarity,
           CAST(row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, other_id) AS INTEGER) AS rank
    FROM dir_{name}) WHERE rank <= {k})"""


def recs(nbname: str = "nbx", name: str = "recx") -> str:
    return f"""sc_{name} AS (
  SELECT s.user_id, n.other_id AS item_id, sum(n.similarity * s.w) / sum(n.similarity) AS score
  FROM st s JOIN {nbname} n ON s.item_id = n.item_id GROUP BY s.user_id, n.other_id),
{name} AS (
  SELECT user_id, item_id, score,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS INTEGER) AS rank
  FROM sc_{name} c
  WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.user_id = c.user_id AND st.item_id = c.item_id))"""


E_CHAIN = [E_RAW, ACTIONS, E_CHK, E_OK, ACC, ST, CNT, PC]


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def sql_interactions() -> dict[str, str]:
    q = {}
    q["interactions_resolved"] = with_(
        [E_RAW, ACTIONS, E_CHK, E_OK],
        "SELECT seq, user_id, item_id, weight, ts, batch_id FROM e_ok")
    q["interactions_rejected"] = with_(
        [E_RAW, ACTIONS, E_CHK],
        "SELECT seq, user_id, item_id, action, reason FROM e_chk WHERE reason IS NOT NULL")
    q["batch_gate"] = with_(
        [E_RAW, ACTIONS, E_CHK,
         """g AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY seq) - 1) / 2) AS BIGINT) AS gate_batch
                  FROM e_chk)""",
         """bad AS (SELECT DISTINCT gate_batch FROM g WHERE reason IS NOT NULL)"""],
        """SELECT seq, user_id, item_id, weight, gate_batch AS batch_id FROM g
           WHERE reason IS NULL AND gate_batch NOT IN (SELECT gate_batch FROM bad)""")
    q["accepted_events"] = with_(
        E_CHAIN[:5], "SELECT seq, user_id, item_id, weight, prev_weight, delta FROM acc")
    q["item_counts"] = with_(E_CHAIN[:7], "SELECT item_id, item_count FROM cnt")
    q["pair_counts"] = with_(
        E_CHAIN, "SELECT item_a, item_b, pair_count, last_touch, touch_item FROM pc")
    q["similarity_exact"] = with_(
        E_CHAIN + [SIMX],
        "SELECT item_a, item_b, pair_count, round(similarity, 6) AS similarity FROM simx")
    q["similarity_replay"] = with_(
        E_CHAIN + [SIMR],
        "SELECT item_a, item_b, pair_count, round(similarity, 6) AS similarity FROM simr")
    q["neighbours_topk"] = with_(
        E_CHAIN + [SIMX, nb("simx")],
        "SELECT item_id, other_id, round(similarity, 6) AS similarity, rank FROM nbx")
    q["neighbours_replay"] = with_(
        E_CHAIN + [SIMR, nb("simr", name="nbr")],
        "SELECT item_id, other_id, round(similarity, 6) AS similarity, rank FROM nbr")
    q["similar_items"] = with_(
        E_CHAIN + [SIMX, nb("simx")],
        """SELECT item_id, other_id, round(similarity, 6) AS similarity, rank FROM nbx
           UNION ALL
           SELECT DISTINCT item_id, item_id, 1.0::DOUBLE, CAST(0 AS INTEGER) FROM nbx""")
    q["recs_item_item"] = with_(
        E_CHAIN + [SIMX, nb("simx"), recs()],
        "SELECT user_id, item_id, round(score, 6) AS score, rank FROM recx")
    q["recs_item_item_replay"] = with_(
        E_CHAIN + [SIMR, nb("simr", name="nbr"), recs("nbr", "recr")],
        "SELECT user_id, item_id, round(score, 6) AS score, rank FROM recr")
    return q


# --------------------------------------------------------------------- ratings
R_RAW = """r_raw AS (
  SELECT CAST(o.o_custkey AS INTEGER) AS userid, CAST(l.l_partkey AS INTEGER) AS itemid,
         ceil(l.l_quantity / 5) / 2 AS rating, CAST(floor(epoch(l.l_shipdate)) AS BIGINT) AS ts,
         l.l_orderkey AS seq_major, CAST(l.l_linenumber AS BIGINT) AS seq_minor
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

R = """r AS (
  SELECT userid, itemid, rating, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY userid, itemid
                                 ORDER BY ts DESC, seq_major DESC, seq_minor DESC) AS rn
    FROM r_raw) WHERE rn = 1)"""

ASOF = """ref_time AS (SELECT max(ts) AS as_of FROM r)"""

ACTIVE = """active AS (SELECT DISTINCT userid FROM r WHERE ts > (SELECT as_of FROM ref_time) - 2592000)"""

R_CHAIN = [R_RAW, R, ASOF, ACTIVE]

STATS = """stats AS (SELECT itemid, avg(rating) AS mean_rating, count(*) AS n_ratings
                    FROM r GROUP BY itemid)"""


def popular(bound: str) -> str:
    return with_(R_CHAIN + [STATS, f"""ranked AS (
  SELECT *, row_number() OVER (ORDER BY n_ratings DESC, itemid) AS rk FROM stats),
kept AS (SELECT * FROM ranked WHERE rk <= floor(({bound}) / 10)),
mx AS (SELECT max(n_ratings) AS max_n, max(mean_rating) AS max_mean FROM kept)"""],
        """SELECT itemid, round(mean_rating, 6) AS mean_rating, n_ratings,
                  round(sqrt(n_ratings) + pi() * sqrt(max_n) / sqrt(max_mean) * sqrt(mean_rating), 6) AS score
           FROM kept, mx""")


def sql_ratings() -> dict[str, str]:
    q = {}
    q["ratings_latest"] = with_(R_CHAIN, "SELECT userid, itemid, rating, ts FROM r")
    q["ratings_keyed"] = with_(
        R_CHAIN, """SELECT userid, itemid, CAST(userid AS VARCHAR) || ':' || CAST(itemid AS VARCHAR) AS rkey,
                           CAST(rating * 2 AS INTEGER) AS rating10 FROM r""")
    q["ratings_after"] = with_(
        R_CHAIN, "SELECT userid, itemid, rating, ts FROM r WHERE ts > (SELECT as_of FROM ref_time) - 604800")
    q["active_users"] = with_(R_CHAIN, "SELECT userid FROM active")
    q["last_n_users"] = with_(
        R_CHAIN, """SELECT DISTINCT userid FROM (
                      SELECT userid FROM r ORDER BY ts DESC, userid DESC, itemid DESC LIMIT 1000)""")
    q["all_users"] = with_(R_CHAIN, "SELECT DISTINCT userid FROM r")
    q["rated_items"] = with_(R_CHAIN, "SELECT DISTINCT itemid FROM r")
    q["catalogue_items"] = "SELECT DISTINCT CAST(p_partkey AS INTEGER) AS itemid FROM part"
    q["unrated_pairs"] = with_(
        R_CHAIN + [E_RAW], """SELECT DISTINCT TRY_CAST(e.user_id AS INTEGER) AS userid, TRY_CAST(e.item_id AS INTEGER) AS itemid
                    FROM e_raw e WHERE TRY_CAST(e.user_id AS INTEGER) IN (SELECT userid FROM active)
                      AND TRY_CAST(e.item_id AS INTEGER) IN (SELECT itemid FROM r)
                      AND NOT EXISTS (SELECT 1 FROM r WHERE r.userid = TRY_CAST(e.user_id AS INTEGER)
                                      AND r.itemid = TRY_CAST(e.item_id AS INTEGER))""")
    q["unrated_pairs_catalogue"] = with_(
        R_CHAIN + [E_RAW], """SELECT DISTINCT TRY_CAST(e.user_id AS INTEGER) AS userid, TRY_CAST(e.item_id AS INTEGER) AS itemid
                    FROM e_raw e WHERE TRY_CAST(e.item_id AS INTEGER) IN (SELECT p_partkey FROM part)
                      AND NOT EXISTS (SELECT 1 FROM r WHERE r.userid = TRY_CAST(e.user_id AS INTEGER)
                                      AND r.itemid = TRY_CAST(e.item_id AS INTEGER))""")
    q["item_stats"] = with_(
        R_CHAIN + [STATS], "SELECT itemid, round(mean_rating, 6) AS mean_rating, n_ratings FROM stats")
    q["popular_items"] = popular("SELECT count(*) FROM r")
    q["popular_items_by_items"] = popular("SELECT count(*) FROM stats")
    q["train_test_split"] = with_(
        R_CHAIN, """SELECT userid, itemid, rating, ts,
                           CASE WHEN row_number() OVER (PARTITION BY userid ORDER BY ts, itemid)
                                     <= floor(count(*) OVER (PARTITION BY userid) * 0.7::DOUBLE)
                                THEN 'train' ELSE 'test' END AS split
                    FROM r""")
    return q


# ----------------------------------------------------------------------- items
I = """i AS (
  SELECT CAST(p_partkey AS INTEGER) AS itemid, replace(p_name, ' ', '|') AS labels,
         p_type AS category, CAST(p_size AS DOUBLE) AS psize, p_retailprice AS pretailprice,
         p_name AS note
  FROM part)"""

LAB = """lab AS (
  SELECT itemid, list_filter(regexp_split_to_array(labels, '[|:]'),
                             lambda x: length(x) > 0 AND x <> '(no genres listed)') AS ls
  FROM i)"""

CATS = """cats AS (
  SELECT category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS index
  FROM (SELECT DISTINCT category FROM i))"""


def sql_items() -> dict[str, str]:
    q = {}
    q["item_features"] = with_(
        [I], """SELECT itemid, concat_ws(',', CAST(psize AS VARCHAR), CAST(pretailprice AS VARCHAR)) AS features
                FROM i""")
    q["item_features_weighted"] = with_(
        [I], """SELECT itemid, concat_ws(',', CAST(psize * 2.0::DOUBLE AS VARCHAR),
                                         CAST(pretailprice * 0.1::DOUBLE AS VARCHAR)) AS features
                FROM i""")
    q["item_onehot"] = with_(
        [I, LAB, "vocab AS (SELECT list_sort(list_distinct(flatten(list(ls)))) AS v FROM lab)"],
        """SELECT itemid, array_to_string(list_transform(v, lambda x: CASE WHEN list_contains(ls, x) THEN '1' ELSE '0' END), ',') AS onehot
           FROM lab, vocab""")
    q["label_vocabulary"] = with_([I, LAB], "SELECT DISTINCT unnest(ls) AS label FROM lab")
    q["category_index"] = with_([I, CATS], "SELECT category, index FROM cats")
    q["item_multihot"] = with_(
        [I, "vocab AS (SELECT list_sort(list_distinct(list(category))) AS v FROM i)",
         "per AS (SELECT itemid, list(DISTINCT category) AS cs FROM i GROUP BY itemid)"],
        """SELECT itemid, array_to_string(list_transform(v, lambda x: CASE WHEN list_contains(cs, x) THEN '1' ELSE '0' END), ',') AS multihot
           FROM per, vocab""")
    q["item_categories"] = with_(
        [I], "SELECT itemid, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM i GROUP BY itemid")
    q["feature_names"] = with_(
        [I, CATS], """SELECT category, regexp_replace(lower(category), '[^a-z]', '', 'g') AS safe_name,
                             'f' || CAST(index AS VARCHAR) AS feature_name FROM cats""")
    q["brand_ids"] = """SELECT CAST(p_partkey AS INTEGER) AS itemid,
                               CAST(string_split(replace(p_brand, '"', ''), '#')[-1] AS INTEGER) AS brand_id
                        FROM part"""
    q["state_to_rating"] = """
      SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS userid, state,
             CASE state WHEN 'Sales Order' THEN 4.0::DOUBLE WHEN 'Done' THEN 5.0::DOUBLE END AS rating
      FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'Sales Order' WHEN 'F' THEN 'Done'
                                         ELSE o_orderstatus END AS state FROM orders)"""
    return q


# ------------------------------------------------------------- hybrid & eval
CANDS = """cands AS (
  SELECT a.userid, i.itemid FROM active a CROSS JOIN (SELECT DISTINCT itemid FROM r) i
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.userid = a.userid AND r.itemid = i.itemid))"""

HYB = """cf AS (SELECT c.userid, c.itemid, m.m AS prediction FROM cands c
               JOIN (SELECT itemid, avg(rating) AS m FROM r GROUP BY itemid) m USING (itemid)),
cb AS (SELECT c.userid, c.itemid, um.m + i.psize / 50.0::DOUBLE AS prediction FROM cands c
       JOIN (SELECT userid, avg(rating) AS m FROM r GROUP BY userid) um USING (userid)
       JOIN i USING (itemid)),
hyb AS (SELECT userid, itemid, cf.prediction * 0.1::DOUBLE + cb.prediction * (1.0::DOUBLE - 0.1::DOUBLE) AS prediction
        FROM cf JOIN cb USING (userid, itemid)),
htop AS (SELECT * FROM (
  SELECT userid, itemid, prediction,
         CAST(row_number() OVER (PARTITION BY userid ORDER BY prediction DESC, itemid) AS INTEGER) AS rank
  FROM hyb) WHERE rank <= 1000)"""

HYB_CHAIN = R_CHAIN + [I, CANDS, HYB]

ONLINE = """online AS (
  SELECT CAST(user_id AS INTEGER) AS userid,
         string_agg(CAST(CAST(item_id AS INTEGER) AS VARCHAR), ':' ORDER BY rank) AS ids
  FROM recx GROUP BY user_id)"""

POP10 = """pstats AS (SELECT itemid, avg(rating) AS mean_rating, count(*) AS n_ratings FROM r GROUP BY itemid),
pmx AS (SELECT max(n_ratings) AS max_n, max(mean_rating) AS max_mean FROM pstats),
pscore AS (SELECT itemid, sqrt(n_ratings) + pi() * sqrt(max_n) / sqrt(max_mean) * sqrt(mean_rating) AS score
           FROM pstats, pmx),
pop10 AS (SELECT itemid, row_number() OVER (ORDER BY score DESC, itemid) AS rank
          FROM pscore ORDER BY score DESC, itemid LIMIT 10),
new10 AS (SELECT itemid, row_number() OVER (ORDER BY first_ts DESC, itemid) AS rank
          FROM (SELECT itemid, min(ts) AS first_ts FROM r GROUP BY itemid)
          ORDER BY first_ts DESC, itemid LIMIT 10)"""

SPLIT = """split AS (
  SELECT userid, itemid, rating, ts,
         CASE WHEN row_number() OVER (PARTITION BY userid ORDER BY ts, itemid)
                   <= floor(count(*) OVER (PARTITION BY userid) * 0.7::DOUBLE)
              THEN 'train' ELSE 'test' END AS split
  FROM r),
train AS (SELECT * FROM split WHERE split = 'train'),
test AS (SELECT * FROM split WHERE split = 'test'),
ecf AS (SELECT t.userid, t.itemid, m.m AS prediction FROM test t
        JOIN (SELECT itemid, avg(rating) AS m FROM train GROUP BY itemid) m USING (itemid)),
ecb AS (SELECT t.userid, t.itemid, um.m + i.psize / 50.0::DOUBLE AS prediction FROM test t
        JOIN (SELECT userid, avg(rating) AS m FROM train GROUP BY userid) um USING (userid)
        JOIN i USING (itemid)),
ehyb AS (SELECT userid, itemid, ecf.prediction * 0.1::DOUBLE + ecb.prediction * (1.0::DOUBLE - 0.1::DOUBLE) AS prediction
         FROM ecf JOIN ecb USING (userid, itemid)),
tlab AS (SELECT userid, itemid, rating,
           CASE WHEN rating >= lo + 0.6::DOUBLE * (hi - lo) THEN 1
                WHEN rating < lo + 0.4::DOUBLE * (hi - lo) THEN 0 END AS label
         FROM test, (SELECT min(rating) AS lo, max(rating) AS hi FROM test)),
tlab1 AS (SELECT * FROM tlab WHERE label IS NOT NULL)"""

EVAL_CHAIN = R_CHAIN + [I, SPLIT]


def rprec(pred: str, name: str) -> str:
    return f"""m_{name} AS (SELECT t.userid, t.itemid, t.rating, p.prediction FROM test t JOIN {pred} p USING (userid, itemid)),
rk_{name} AS (SELECT *, CASE WHEN rating >= 4 THEN 1 ELSE 0 END AS pos,
                   row_number() OVER (PARTITION BY userid ORDER BY prediction DESC, itemid) AS rk
            FROM m_{name}),
rp_{name} AS (SELECT userid, CAST(sum(pos) AS BIGINT) AS n_pos,
                   CASE WHEN sum(pos) > 0
                        THEN CAST(sum(CASE WHEN rk <= np THEN pos ELSE 0 END) AS DOUBLE) / sum(pos) END AS r_precision
            FROM (SELECT *, sum(pos) OVER (PARTITION BY userid) AS np FROM rk_{name}) GROUP BY userid),
mrp_{name} AS (SELECT avg(CASE WHEN r_precision > 0 AND NOT isnan(r_precision) THEN r_precision END) AS mean_r_precision
             FROM rp_{name})"""


def sql_hybrid_eval() -> dict[str, str]:
    q = {}
    q["linear_scores"] = with_(
        R_CHAIN + [I, CANDS, """coefs AS (SELECT userid, avg(rating) AS intercept,
                                             count(*) / 1000.0::DOUBLE AS c0, 0.001::DOUBLE AS c1
                                      FROM r GROUP BY userid)""",
                   """ls AS (SELECT c.userid, c.itemid,
                                    k.intercept + ((k.c0 * i.psize) + (k.c1 * i.pretailprice)) AS prediction
                             FROM cands c JOIN coefs k USING (userid) JOIN i USING (itemid))"""],
        """SELECT * FROM (
             SELECT userid, itemid, prediction,
                    CAST(row_number() OVER (PARTITION BY userid ORDER BY prediction DESC, itemid) AS INTEGER) AS rank
             FROM ls) WHERE rank <= 10""")
    q["hybrid_topk"] = with_(HYB_CHAIN, "SELECT userid, itemid, prediction, rank FROM htop")
    q["hybrid_lists"] = with_(
        HYB_CHAIN, """SELECT userid, string_agg(CAST(itemid AS VARCHAR), ':' ORDER BY rank) AS recommended_ids
                      FROM htop GROUP BY userid""")
    q["serve_with_fallback"] = with_(
        HYB_CHAIN + E_CHAIN + [SIMX, nb("simx"), recs(), ONLINE,
                               """stored AS (SELECT userid, string_agg(CAST(itemid AS VARCHAR), ':' ORDER BY rank) AS ids
                                             FROM (SELECT * FROM htop WHERE rank <= 10) GROUP BY userid)""",
                               """users AS (SELECT DISTINCT userid FROM r
                                            UNION SELECT CAST(user_id AS INTEGER) FROM events)"""],
        """SELECT u.userid,
                  coalesce(s.ids, array_to_string((string_split(o.ids, ':'))[1:10], ':'), '') AS recommended_ids,
                  CASE WHEN s.ids IS NOT NULL THEN 'batch' WHEN o.ids IS NOT NULL THEN 'online' ELSE 'none' END AS source
           FROM users u LEFT JOIN stored s USING (userid) LEFT JOIN online o USING (userid)""")
    q["final_padded"] = with_(
        HYB_CHAIN + [POP10, """users AS (SELECT DISTINCT userid FROM r)""",
                     """pc AS (SELECT userid, itemid, 0 AS src, rank AS rr FROM htop
                              UNION ALL SELECT u.userid, p.itemid, 1, p.rank FROM users u CROSS JOIN pop10 p
                              UNION ALL SELECT u.userid, n.itemid, 2, n.rank FROM users u CROSS JOIN new10 n)""",
                     """pc2 AS (SELECT * FROM pc WHERE NOT EXISTS
                                 (SELECT 1 FROM r WHERE r.userid = pc.userid AND r.itemid = pc.itemid))""",
                     """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY userid, itemid ORDER BY src, rr) AS k
                                               FROM pc2) WHERE k = 1)""",
                     """fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY userid ORDER BY src, rr, itemid) AS rank
                                              FROM best) WHERE rank <= 10)"""],
        """SELECT userid, string_agg(CAST(itemid AS VARCHAR), ':' ORDER BY rank) AS recommended_ids
           FROM fin GROUP BY userid""")
    q["eval_labels"] = with_(EVAL_CHAIN, "SELECT userid, itemid, rating, label FROM tlab1")
    q["eval_accuracy"] = with_(
        EVAL_CHAIN + ["""plab AS (SELECT userid, itemid,
                            CASE WHEN prediction >= lo + 0.6::DOUBLE * (hi - lo) THEN 1
                                 WHEN prediction < lo + 0.4::DOUBLE * (hi - lo) THEN 0 END AS label
                          FROM ehyb, (SELECT min(prediction) AS lo, max(prediction) AS hi FROM ehyb))"""],
        """SELECT round(avg(CASE WHEN t.label = p.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n_pairs
           FROM tlab1 t JOIN (SELECT * FROM plab WHERE label IS NOT NULL) p USING (userid, itemid)""")
    weights = ", ".join(f"({w}::DOUBLE)" for w in SWEEP)
    q["eval_weight_sweep"] = with_(
        EVAL_CHAIN + [f"""grid AS (SELECT * FROM (VALUES {weights}) g(weight))""",
                      """sw AS (SELECT userid, itemid, weight,
                                       ecf.prediction * weight + ecb.prediction * (1.0::DOUBLE - weight) AS prediction
                                FROM ecf JOIN ecb USING (userid, itemid) CROSS JOIN grid)""",
                      """swl AS (SELECT sw.*, CASE WHEN prediction >= lo + 0.6::DOUBLE * (hi - lo) THEN 1
                                                   WHEN prediction < lo + 0.4::DOUBLE * (hi - lo) THEN 0 END AS label
                                 FROM sw JOIN (SELECT weight, min(prediction) AS lo, max(prediction) AS hi
                                               FROM sw GROUP BY weight) l USING (weight))""",
                      """acc AS (SELECT weight, avg(CASE WHEN t.label = s.label THEN 1.0 ELSE 0.0 END) AS accuracy,
                                        count(*) AS n_pairs
                                 FROM (SELECT * FROM swl WHERE label IS NOT NULL) s JOIN tlab1 t USING (userid, itemid)
                                 GROUP BY weight)"""],
        """SELECT weight, round(accuracy, 6) AS accuracy, n_pairs,
                  weight = (SELECT weight FROM acc ORDER BY accuracy DESC, weight LIMIT 1) AS best
           FROM acc""")
    q["pipeline_sweep"] = with_(
        EVAL_CHAIN + [f"""grid AS (SELECT * FROM (VALUES {weights}) g(weight))""",
                      """upm AS (SELECT userid, avg(rating) AS um FROM train GROUP BY userid)""",
                      """ucm AS (SELECT userid, category, avg(rating) AS m FROM train JOIN i USING (itemid)
                                 GROUP BY userid, category)""",
                      """side AS (SELECT 0 AS pid, 'size' AS pipeline, userid, itemid, prediction FROM ecb
                                  UNION ALL SELECT 1, 'price', t.userid, t.itemid, u.um + i.pretailprice / 1000.0::DOUBLE
                                  FROM test t JOIN upm u USING (userid) JOIN i USING (itemid)
                                  UNION ALL SELECT 2, 'category', t.userid, t.itemid, c.m
                                  FROM test t JOIN i USING (itemid) JOIN ucm c USING (userid, category))""",
                      """sw AS (SELECT pid, pipeline, userid, itemid, weight,
                                       ecf.prediction * weight + side.prediction * (1.0::DOUBLE - weight) AS prediction
                                FROM ecf JOIN side USING (userid, itemid) CROSS JOIN grid)""",
                      """swl AS (SELECT sw.*, CASE WHEN prediction >= lo + 0.6::DOUBLE * (hi - lo) THEN 1
                                                   WHEN prediction < lo + 0.4::DOUBLE * (hi - lo) THEN 0 END AS label
                                 FROM sw JOIN (SELECT pid, weight, min(prediction) AS lo, max(prediction) AS hi
                                               FROM sw GROUP BY pid, weight) l USING (pid, weight))""",
                      """acc AS (SELECT s.pid, s.pipeline, s.weight,
                                        avg(CASE WHEN t.label = s.label THEN 1.0 WHEN t.label <> s.label THEN 0.0 END) AS accuracy,
                                        count(CASE WHEN t.label IS NOT NULL AND s.label IS NOT NULL THEN 1 END) AS n_pairs
                                 FROM swl s LEFT JOIN tlab1 t USING (userid, itemid)
                                 GROUP BY s.pid, s.pipeline, s.weight)""",
                      """top AS (SELECT pid, weight FROM acc WHERE accuracy IS NOT NULL
                                 ORDER BY accuracy DESC, pid, weight LIMIT 1)"""],
        """SELECT pipeline, weight, round(accuracy, 6) AS accuracy, n_pairs,
                  EXISTS (SELECT 1 FROM top WHERE top.pid = acc.pid AND top.weight = acc.weight) AS best
           FROM acc""")
    q["eval_precision"] = with_(
        EVAL_CHAIN, """SELECT round(avg(CASE WHEN t.rating > 3 AND h.prediction > 3 THEN 1.0 ELSE 0.0 END), 6) AS precision,
                              count(*) AS n_pairs
                       FROM test t JOIN ehyb h USING (userid, itemid)""")
    q["r_precision"] = with_(
        EVAL_CHAIN + [rprec("ehyb", "h")],
        "SELECT userid, n_pos, round(r_precision, 6) AS r_precision FROM rp_h")
    q["mean_r_precision"] = with_(
        EVAL_CHAIN + [rprec("ehyb", "h")], "SELECT round(mean_r_precision, 6) AS mean_r_precision FROM mrp_h")
    q["model_comparison"] = with_(
        EVAL_CHAIN + [rprec("ecf", "cf"), rprec("ecb", "cb"), rprec("ehyb", "h")],
        """SELECT 'cf' AS family, round(mean_r_precision, 6) AS mean_r_precision FROM mrp_cf
           UNION ALL SELECT 'cb', round(mean_r_precision, 6) FROM mrp_cb
           UNION ALL SELECT 'hybrid', round(mean_r_precision, 6) FROM mrp_h""")
    return q


# The weight grid, 0.10 to 1.00 in steps of 0.05.
SWEEP = ["0.1", "0.15", "0.2", "0.25", "0.3", "0.35", "0.4", "0.45", "0.5", "0.55",
         "0.6", "0.65", "0.7", "0.75", "0.8", "0.85", "0.9", "0.95", "1.0"]


def oracle_sql() -> dict[str, str]:
    q = {}
    q.update(sql_interactions())
    q.update(sql_ratings())
    q.update(sql_items())
    q.update(sql_hybrid_eval())
    q["item_lookup"] = with_(
        [I], """SELECT e.itemid, i.category, i.psize, i.itemid IS NOT NULL AS found
                FROM (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS INTEGER) AS itemid FROM events) e
                LEFT JOIN i USING (itemid)""")
    q["active_user_predictions"] = with_(
        HYB_CHAIN, """SELECT userid, itemid, prediction, rank FROM htop
                      WHERE userid IN (SELECT userid FROM (
                        SELECT userid FROM r ORDER BY ts DESC, userid DESC, itemid DESC LIMIT 1000))""")
    q["stored_lists_top"] = with_(
        HYB_CHAIN, """SELECT userid, CAST(count(*) AS INTEGER) AS n_ids,
                             string_agg(CAST(itemid AS VARCHAR), ':' ORDER BY rank) AS recommended_ids
                      FROM htop WHERE rank <= 10 GROUP BY userid""")
    q["recent_ratings"] = with_(
        R_CHAIN, "SELECT userid, itemid, rating, ts FROM r WHERE ts > (SELECT as_of FROM ref_time) - 2592000")
    q["item_dictionary"] = with_(
        [I], """SELECT itemid, 'psize' AS feature, psize AS value FROM i
                UNION ALL SELECT itemid, 'pretailprice', pretailprice FROM i""")
    q["stream_active_users"] = with_(
        [E_RAW], """SELECT DISTINCT user_id FROM e_raw WHERE ts > (SELECT max(ts) FROM e_raw) - 86400""")
    q["libsvm_roundtrip"] = q["item_features"]
    q["ratings_csv_roundtrip"] = with_(
        R_CHAIN, "SELECT userid, itemid, rating, CAST(ts AS VARCHAR) AS timestamp FROM r")
    q["item_json_ingest"] = with_([I], "SELECT itemid, psize, pretailprice, note FROM i")
    q["actions_registered"] = with_(
        [ACTIONS], """SELECT name, weight FROM actions
                      UNION ALL
                      SELECT DISTINCT event_type, 1.0::DOUBLE FROM events
                      WHERE event_type NOT IN (SELECT name FROM actions)""")
    q["item_upserts"] = """
        SELECT CAST(l_partkey AS BIGINT) AS itemid, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, CAST(l_orderkey AS BIGINT) AS seq,
               CAST(l_linenumber AS INTEGER) AS line, CAST(l_quantity AS DOUBLE) AS quantity,
               CAST(l_extendedprice AS DOUBLE) AS price
        FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(l_shipdate AS DATE) DESC, l_orderkey DESC,
                                   l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) = 1"""
    # the streaming learner's summed deltas equal the batch statistics
    q["stream_item_counts"] = q["item_counts"]
    q["stream_pair_counts"] = with_(E_CHAIN, "SELECT item_a, item_b, pair_count FROM pc")
    q["stream_similarity"] = q["similarity_exact"]
    q["stream_deltas"] = with_(
        E_CHAIN, """SELECT 'item' AS kind, item_id AS item_a, NULL::VARCHAR AS item_b, item_count AS delta,
                           (SELECT max(last_seq) FROM st WHERE st.item_id = cnt.item_id) AS seq FROM cnt
                    UNION ALL SELECT 'pair', item_a, item_b, pair_count, last_touch FROM pc""")
    q["stream_rescored"] = with_(
        E_CHAIN + [RECENT_E], f"""SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank,
                                         (SELECT max(ts) FROM e_ok) AS as_of
                                  FROM ({q["recs_item_item"]}) x
                                  WHERE rank <= 10 AND user_id IN (SELECT user_id FROM recent_e)""")
    q["erp_forward_fill"] = """SELECT CAST(l_orderkey AS INTEGER) AS orderid, CAST(l_linenumber AS INTEGER) AS line,
                                      l_returnflag AS category FROM lineitem"""
    q["user_export"] = with_(
        R_CHAIN, """SELECT userid, itemid, rating AS prediction FROM r
                    WHERE userid IN (SELECT userid FROM (
                      SELECT userid FROM r ORDER BY ts DESC, userid DESC, itemid DESC LIMIT 50))""")
    q["cluster_mates"] = with_(
        R_CHAIN + [I, """placed AS (SELECT itemid, psize, CAST((row_number() OVER (PARTITION BY psize ORDER BY itemid) - 1) // 16
                                           AS INTEGER) AS page FROM i)""",
                   POP10],
        """SELECT w.itemid, p.page,
                  coalesce(string_agg(CAST(p.itemid AS VARCHAR), ':' ORDER BY p.itemid) FILTER (p.itemid <> w.itemid), '') AS similar_items
           FROM pop10 w JOIN i ON i.itemid = w.itemid JOIN placed p ON p.psize = i.psize
           GROUP BY w.itemid, p.page""")
    q["stream_rejected"] = q["interactions_rejected"]
    return q
