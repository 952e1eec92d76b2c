"""Queries that depend on the order of a user's actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.aggregates import stats
from riskloom.operators import sequences
from riskloom.operators.scores import cumulative
from riskloom.operators.text import joined_documents, token_lists
from riskloom.plans.registry import ACTIONS, finish, finished, query, stats_sql
from riskloom.sources.tables import actions, load

ORDER = ["us", "event_id"]
SIX = ("mean", "max", "min", "sum", "std", "skew")
W = "(PARTITION BY uid ORDER BY us, event_id)"


@query(finished(f"WITH {ACTIONS}, g AS (SELECT uid, (us - lag(us) OVER {W}) / 1000000.0 AS gap FROM a WHERE action_type = 2) SELECT uid, {stats_sql('gap', SIX)} FROM g GROUP BY uid", "uid"))
def lag_diff_stats(spark, sf):
    rows = sequences.lag_difference(actions(spark, sf).where("action_type = 2"), "uid", ORDER, "us", "gap").withColumn("gap", F.col("gap") / 1e6)
    return finish(rows.groupBy("uid").agg(*stats("gap", SIX)), "uid")


@query(f"WITH {ACTIONS} SELECT event_id, CASE WHEN lead(us) OVER {W} IS NULL THEN 99999 ELSE CAST(floor((lead(us) OVER {W} - us) / 1000000.0) AS BIGINT) % 86400 END AS gap FROM a")
def lead_gap_seconds(spark, sf):
    return sequences.lead_gap(actions(spark, sf), "uid", ORDER, "us", "gap").select("event_id", F.col("gap").cast("long").alias("gap"))


@query(finished(f"WITH {ACTIONS}, d AS (SELECT event_id, coalesce(value - lag(value) OVER {W}, 0) AS diff, value FROM a) SELECT event_id, diff, greatest(diff, 0) AS up, least(diff, 0) AS down, abs(diff) AS size, diff / nullif(value, 0) AS share FROM d", "event_id"))
def amount_deltas(spark, sf):
    rows = sequences.lag_difference(actions(spark, sf), "uid", ORDER, "value", "diff").withColumn("diff", F.coalesce("diff", F.lit(0.0)))
    return finish(rows.select("event_id", "diff", F.greatest("diff", F.lit(0.0)).alias("up"), F.least("diff", F.lit(0.0)).alias("down"), F.abs("diff").alias("size"), F.try_divide("diff", "value").alias("share")), "event_id")


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) + (count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - 1) / 2.0 AS place FROM orders")
def rank_average(spark, sf):
    rows = sequences.average_rank(load(spark, sf, "orders"), "o_custkey", "o_orderpriority", "place")
    return rows.select("o_orderkey", F.col("place").cast("double").alias("place"))


@query(f"WITH {ACTIONS} SELECT event_id, row_number() OVER (PARTITION BY uid, mode ORDER BY us, event_id) - 1 AS place FROM a")
def cumcount_marker(spark, sf):
    return sequences.cumulative_count(actions(spark, sf), ["uid", "mode"], ORDER, "place").select("event_id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {ACTIONS} SELECT event_id, last_value(dev IGNORE NULLS) OVER (PARTITION BY uid ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS forward,
 first_value(dev IGNORE NULLS) OVER (PARTITION BY uid ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM a""")
def ffill_bfill(spark, sf):
    rows = actions(spark, sf).withColumns({"forward": F.col("dev"), "backward": F.col("dev")})
    rows = sequences.fill_forward(rows, "uid", ORDER, ["forward"])
    return sequences.fill_backward(rows, "uid", ORDER, ["backward"]).select("event_id", "forward", "backward")


@query(finished(f"""WITH {ACTIONS}, c AS (SELECT uid, CASE WHEN dev IS DISTINCT FROM lag(dev) OVER {W} THEN 1 ELSE 0 END AS f, (us - lag(us) OVER {W}) / 60000000.0 AS m FROM a)
 SELECT uid, coalesce(sum(f), 0) AS dev_changed_all_sum, avg(f) AS dev_changed_all_mean, coalesce(sum(f) FILTER (m <= 600), 0) AS dev_changed_day_sum, avg(f) FILTER (m <= 600) AS dev_changed_day_mean,
 coalesce(sum(f) FILTER (m <= 60), 0) AS dev_changed_hour_sum, avg(f) FILTER (m <= 60) AS dev_changed_hour_mean FROM c GROUP BY uid""", "uid"))
def change_flags_time_bounded(spark, sf):
    return finish(sequences.change_stats(actions(spark, sf), "uid", ORDER, "us", ["dev"], {"day": 600, "hour": 60}), "uid")


_WINDOWS = (600, 1800, 3600, 36000, 86400, 259200, 864000)


@query("WITH " + ACTIONS + ", l AS (SELECT uid, action_type, (max(us) OVER (PARTITION BY uid) - us) / 1000000.0 AS b FROM a) SELECT uid, " + ", ".join(f"count(*) FILTER (action_type = 1 AND b <= {s}) AS op_{s}, count(*) FILTER (action_type = 2 AND b <= {s}) AS trade_{s}" for s in _WINDOWS) + " FROM l GROUP BY uid")
def trailing_window_counts(spark, sf):
    return sequences.trailing_counts(actions(spark, sf), "uid", "us", _WINDOWS, {"op": F.col("action_type") == 1, "trade": F.col("action_type") == 2})


def _transition(first: str, second: str, limit: int) -> str:
    return finished(f"""WITH {ACTIONS}, r AS (SELECT uid, us, {first} AS f, lag({first}) OVER {W} AS before, (us - lag(us) OVER {W}) / 1000000.0 AS span FROM a WHERE {first} OR {second}),
 p AS (SELECT uid, count(*) FILTER (span <= {limit}) / (sum(span) + 1.0) AS s FROM r WHERE before AND NOT f GROUP BY uid) SELECT uid, coalesce(s, 0.0) AS score FROM (SELECT DISTINCT uid FROM a) LEFT JOIN p USING (uid)""", "uid", digits=10)


@query(_transition("mode = 'view'", "mode = 'purchase'", 40000))
def transition_span_score(spark, sf):
    rows = sequences.transition_score(actions(spark, sf), "uid", ORDER, "us", F.col("mode") == "view", F.col("mode") == "purchase", "score", 40_000)
    return finish(rows, "uid", digits=10)


@query(_transition("action_type = 1", "action_type = 2", 100))
def operation_to_trade_score(spark, sf):
    rows = sequences.transition_score(actions(spark, sf), "uid", ORDER, "us", F.col("action_type") == 1, F.col("action_type") == 2, "score")
    return finish(rows, "uid", digits=10)


@query(f"""WITH {ACTIONS}, g AS (SELECT *, CASE WHEN lead(us) OVER {W} IS NULL THEN 99999 ELSE CAST(floor((lead(us) OVER {W} - us) / 1000000.0) AS BIGINT) % 86400 END AS gap FROM a)
 SELECT event_id, CAST(coalesce(sum(CASE WHEN gap > 20000 THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS session FROM g""")
def session_numbers(spark, sf):
    rows = sequences.sessions(actions(spark, sf), "uid", ORDER, "us", "session", limit=20_000)
    return rows.select("event_id", F.col("session").cast("long").alias("session"))


@query(f"WITH {ACTIONS} SELECT uid, string_agg(mode, ' ' ORDER BY us, event_id) AS document FROM a GROUP BY uid")
def doc_from_modes(spark, sf):
    return joined_documents(actions(spark, sf), "uid", "mode", ORDER)


@query(f"WITH {ACTIONS}, t AS (SELECT uid, list(coalesce(CAST(dev AS VARCHAR), 'nan') ORDER BY us, event_id) AS l FROM a GROUP BY uid) SELECT uid, len(l) AS n, array_to_string(l, ',') AS listed FROM t")
def ordered_list(spark, sf):
    return token_lists(actions(spark, sf), "uid", "dev", ORDER).select("uid", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", ",").alias("listed"))


@query("SELECT c_custkey AS tie, CAST(row_number() OVER w AS BIGINT) AS place, CAST(sum(CASE WHEN c_nationkey < 5 THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS marked FROM customer WINDOW w AS (ORDER BY c_acctbal DESC, c_custkey)")
def cumulative_by_score(spark, sf):
    rows = load(spark, sf, "customer").withColumn("y", (F.col("c_nationkey") < 5).cast("int"))
    return cumulative(rows, "c_acctbal", "y", "c_custkey").select("tie", F.col("place").cast("long").alias("place"), F.col("marked").cast("long").alias("marked"))
