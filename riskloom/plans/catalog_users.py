"""Queries that aggregate per user, per entity, and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.aggregates import first_by, last_by, stats
from riskloom.functions.scalar import guarded_ratio, null_count
from riskloom.operators import pivots, profiles
from riskloom.operators.relational import attach
from riskloom.operators.sequences import lag_difference, lead_gap, sessions
from riskloom.plans import aggspec
from riskloom.plans.registry import ACTIONS, PAYMENTS, STATS_SQL, finish, finished, query, stats_sql
from riskloom.sources.tables import actions, load, payments

BASIC = ("count", "nunique", "sum", "mean", "min", "max", "var", "std", "skew")
ROLL = ("max", "min", "sum", "mean", "std", "skew")
FIVE = ("mean", "max", "min", "skew", "std")


@query(finished(f"""WITH {ACTIONS} SELECT uid, count(*) AS actions, count(*) FILTER (action_type = 1) AS operations, count(*) FILTER (action_type = 2) AS trades,
 count(*) FILTER (action_type = 2) / (0.01 + count(*) FILTER (action_type = 1)) AS trade_ratio, count(DISTINCT ip) AS ips, count(DISTINCT day) AS days,
 (max(us) - min(us)) / 1000000.0 AS span, coalesce(sum(CASE WHEN action_type = 2 THEN value END), 0) AS amount, avg(CASE WHEN action_type = 2 THEN value END) AS mean_amount FROM a GROUP BY uid""", "uid"))
def flag_user_profile(spark, sf):
    trade = F.col("action_type") == 2
    rows = actions(spark, sf).groupBy("uid").agg(
        F.count("*").alias("actions"), F.count_if(~trade).alias("operations"), F.count_if(trade).alias("trades"), guarded_ratio(F.count_if(trade), F.count_if(~trade)).alias("trade_ratio"),
        F.count_distinct("ip").alias("ips"), F.count_distinct("day").alias("days"), ((F.max("us") - F.min("us")) / 1e6).alias("span"),
        F.coalesce(F.sum(F.when(trade, F.col("value"))), F.lit(0)).alias("amount"), F.avg(F.when(trade, F.col("value"))).alias("mean_amount"),
    )
    return finish(rows, "uid")


@query(finished(f"WITH {ACTIONS} SELECT uid, {stats_sql('hour', BASIC)}, {stats_sql('value', [b for b in BASIC if b != 'var'])} FROM a GROUP BY uid", "uid"))
def user_basic_stats(spark, sf):
    rows = actions(spark, sf).groupBy("uid").agg(*stats("hour", BASIC), *stats("value", [b for b in BASIC if b != "var"]))
    return finish(rows, "uid")


@query(finished("SELECT l_suppkey, " + stats_sql("l_quantity", BASIC) + " FROM lineitem GROUP BY l_suppkey", "l_suppkey"))
def supplier_basic_stats(spark, sf):
    return finish(load(spark, sf, "lineitem").groupBy("l_suppkey").agg(*stats("l_quantity", BASIC)), "l_suppkey")


@query("""SELECT o_custkey, first(x ORDER BY o_orderdate, o_orderkey) FILTER (x IS NOT NULL) AS first_price, last(x ORDER BY o_orderdate, o_orderkey) FILTER (x IS NOT NULL) AS last_price
 FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS x FROM orders) GROUP BY o_custkey""")
def user_first_last_value(spark, sf):
    order = F.struct("o_orderdate", "o_orderkey")
    x = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return load(spark, sf, "orders").groupBy("o_custkey").agg(first_by(x, order).alias("first_price"), last_by(x, order).alias("last_price"))


@query(f"""WITH {ACTIONS}, c AS (SELECT uid, dev, count(*) AS n FROM a WHERE dev IS NOT NULL GROUP BY ALL) SELECT uid, CASE WHEN count(*) > 1 THEN first(dev ORDER BY n DESC, dev) END AS dev_mode FROM c GROUP BY uid""")
def user_mode_if_mixed(spark, sf):
    return profiles.mode_if_mixed(actions(spark, sf), ["uid"], "dev", "dev_mode")


@query(finished(f"""WITH {ACTIONS}, c AS (SELECT uid, mode, count(*) AS n FROM a GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, mode) AS r FROM c)
 SELECT uid, max(CASE WHEN r = 1 THEN mode END) AS mode_top1, max(CASE WHEN r = 2 THEN mode END) AS mode_top2, max(CASE WHEN r = 1 THEN n END) AS mode_count1, max(CASE WHEN r = 2 THEN n END) AS mode_count2,
 max(CASE WHEN r = 2 THEN n END) / CAST(max(CASE WHEN r = 1 THEN n END) AS DOUBLE) AS mode_second_ratio FROM r WHERE r <= 2 GROUP BY uid""", "uid", "mode_top1", "mode_top2"))
def user_mode_and_top2(spark, sf):
    return finish(profiles.top_two(actions(spark, sf), "uid", "mode"), "uid")


@query(finished(f"""WITH {ACTIONS}, c AS (SELECT uid, ip, count(*) AS n FROM a GROUP BY ALL), t AS (SELECT uid, sum(n) AS rows FROM c GROUP BY uid),
 f AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, ip DESC) AS r FROM c WHERE ip IS NOT NULL)
 SELECT t.uid, f.ip AS ip_favourite, coalesce(f.n, 0) AS ip_favourite_count, coalesce(f.n, 0) / CAST(t.rows AS DOUBLE) AS ip_favourite_rate FROM t LEFT JOIN f ON t.uid = f.uid AND r = 1""", "uid"))
def user_favorite_attr(spark, sf):
    return finish(profiles.favourite(actions(spark, sf), "uid", "ip"), "uid")


@query(finished(f"WITH {ACTIONS}, c AS (SELECT uid, mode, count(*) AS n FROM a GROUP BY ALL), t AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY uid) AS DOUBLE) AS p FROM c) SELECT uid, -sum(p * log2(p)) AS mode_entropy FROM t GROUP BY uid", "uid"))
def user_entropy(spark, sf):
    return finish(profiles.entropy(actions(spark, sf), "uid", "mode"), "uid")


@query(finished(f"WITH {ACTIONS} SELECT uid, {stats_sql('hour', ('count', 'nunique', 'max', 'min', 'sum', 'mean', 'std'))} FROM a GROUP BY uid", "uid"))
def user_hour_stats(spark, sf):
    return finish(actions(spark, sf).groupBy("uid").agg(*stats("hour", ("count", "nunique", "max", "min", "sum", "mean", "std"))), "uid")


@query(finished(f"WITH {ACTIONS} SELECT uid, {stats_sql('day', ('mean', 'max', 'min', 'sum', 'skew', 'std'))} FROM a GROUP BY uid", "uid"))
def user_day_stats(spark, sf):
    return finish(actions(spark, sf).groupBy("uid").agg(*stats("day", ("mean", "max", "min", "sum", "skew", "std"))), "uid")


@query(finished(f"""WITH {PAYMENTS} SELECT uid, {stats_sql('amount', ('mean', 'sum', 'max', 'min', 'std', 'skew'))}, max(amount) - min(amount) AS amount_range FROM p GROUP BY uid""", "uid"))
def user_amount_stats(spark, sf):
    rows = payments(spark, sf).groupBy("uid").agg(*stats("amount", ("mean", "sum", "max", "min", "std", "skew")), (F.max("amount") - F.min("amount")).alias("amount_range"))
    return finish(rows, "uid")


@query(finished(f"""WITH {ACTIONS}, m AS (SELECT uid, (CASE WHEN ip IS NULL THEN 1 ELSE 0 END) + (CASE WHEN dev IS NULL THEN 1 ELSE 0 END) AS missing, ip, dev FROM a)
 SELECT uid, avg(missing) AS missing_mean, max(missing) AS missing_max, count(ip) AS ip_known, count(ip) / (0.01 + count(*)) AS ip_rate, count(dev) AS dev_known, count(dev) / (0.01 + count(*)) AS dev_rate FROM m GROUP BY uid""", "uid"))
def user_missingness(spark, sf):
    rows = actions(spark, sf).withColumn("missing", null_count("ip", "dev"))
    return finish(rows.groupBy("uid").agg(
        F.avg("missing").alias("missing_mean"), F.max("missing").alias("missing_max"), F.count("ip").alias("ip_known"), guarded_ratio(F.count("ip"), F.count("*")).alias("ip_rate"),
        F.count("dev").alias("dev_known"), guarded_ratio(F.count("dev"), F.count("*")).alias("dev_rate"),
    ), "uid")


@query(finished(f"""WITH {ACTIONS} SELECT uid, count(DISTINCT ip) AS ip_all, count(DISTINCT CASE WHEN action_type = 1 THEN ip END) AS ip_op, count(DISTINCT CASE WHEN action_type = 2 THEN ip END) AS ip_trade,
 count(DISTINCT CASE WHEN action_type = 2 THEN ip END) - count(DISTINCT CASE WHEN action_type = 1 THEN ip END) AS ip_diff, count(DISTINCT dev) AS dev_all,
 count(DISTINCT CASE WHEN action_type = 1 THEN dev END) AS dev_op, count(DISTINCT CASE WHEN action_type = 2 THEN dev END) AS dev_trade FROM a GROUP BY uid""", "uid"))
def user_nunique_by_type(spark, sf):
    # One row per (user, type, value) first: the distinct counts become plain ones.
    rows = actions(spark, sf).select("uid", "action_type", F.inline(F.array(F.struct(F.lit("ip").alias("c"), F.col("ip").alias("v")), F.struct(F.lit("dev").alias("c"), F.col("dev").alias("v")))))
    pairs = rows.groupBy("uid", "c", "v").agg(F.max((F.col("action_type") == 1).cast("int")).alias("op"), F.max((F.col("action_type") == 2).cast("int")).alias("trade"))
    known = F.col("v").isNotNull()

    def n(c, flag=F.lit(1)):
        return F.coalesce(F.sum(F.when(known & (F.col("c") == c), flag)), F.lit(0))

    return finish(pairs.groupBy("uid").agg(
        n("ip").alias("ip_all"), n("ip", F.col("op")).alias("ip_op"), n("ip", F.col("trade")).alias("ip_trade"), (n("ip", F.col("trade")) - n("ip", F.col("op"))).alias("ip_diff"),
        n("dev").alias("dev_all"), n("dev", F.col("op")).alias("dev_op"), n("dev", F.col("trade")).alias("dev_trade"),
    ), "uid")


@query(finished(f"""WITH {ACTIONS}, o AS (SELECT DISTINCT uid, coalesce(CAST(dev AS VARCHAR), 'nan') AS v FROM a WHERE action_type = 1), t AS (SELECT DISTINCT uid, coalesce(CAST(dev AS VARCHAR), 'nan') AS v FROM a WHERE action_type = 2),
 u AS (SELECT uid, count(*) AS n, count(*) FILTER (s = 2) AS shared FROM (SELECT uid, v, count(*) AS s FROM (SELECT * FROM o UNION ALL SELECT * FROM t) GROUP BY ALL) GROUP BY uid)
 SELECT uid, CASE WHEN uid IN (SELECT uid FROM o) AND uid IN (SELECT uid FROM t) THEN shared / CAST(n AS DOUBLE) END AS dev_overlap FROM u""", "uid"))
def user_jaccard_attr(spark, sf):
    a = actions(spark, sf)
    return finish(profiles.set_overlap(a.where("action_type = 1"), a.where("action_type = 2"), "uid", "dev", "dev_overlap"), "uid")


@query(finished(f"""WITH {ACTIONS} SELECT uid, count(DISTINCT day) AS days_all, count(DISTINCT CASE WHEN action_type = 1 THEN day END) AS days_op, count(DISTINCT CASE WHEN action_type = 2 THEN day END) AS days_trade,
 count(DISTINCT CASE WHEN action_type = 2 THEN day END) / (0.01 + count(DISTINCT day)) AS trade_share, count_if(success >= 0 AND success = 1) AS ok, avg(CASE WHEN success >= 0 THEN success END) AS ok_rate FROM a GROUP BY uid""", "uid"))
def user_active_days(spark, sf):
    days = actions(spark, sf).groupBy("uid", "day").agg(
        F.max((F.col("action_type") == 1).cast("int")).alias("op"), F.max((F.col("action_type") == 2).cast("int")).alias("trade"),
        F.count_if(F.col("success") == 1).alias("ok"), F.count_if(F.col("success") >= 0).alias("known"),
    )
    return finish(days.groupBy("uid").agg(
        F.count("*").alias("days_all"), F.sum("op").alias("days_op"), F.sum("trade").alias("days_trade"), guarded_ratio(F.sum("trade"), F.count("*")).alias("trade_share"),
        F.sum("ok").alias("ok"), F.try_divide(F.sum("ok"), F.sum("known")).alias("ok_rate"),
    ), "uid")


# ------------------------------------------------------------ two levels
@query(finished(f"WITH {ACTIONS}, d AS (SELECT uid, day, count(DISTINCT ip) AS ips FROM a GROUP BY ALL) SELECT uid, {stats_sql('ips', FIVE)} FROM d GROUP BY uid", "uid"))
def user_day_nunique_rollup(spark, sf):
    return finish(profiles.two_level(actions(spark, sf), "uid", ["day"], {"ips": F.count_distinct("ip")}, FIVE), "uid")


@query(finished(f"WITH {ACTIONS}, d AS (SELECT uid, day, (max(us) - min(us)) / 1000000.0 AS span FROM a WHERE action_type = 2 GROUP BY ALL) SELECT uid, {stats_sql('span', FIVE)} FROM d GROUP BY uid", "uid"))
def user_day_trade_span(spark, sf):
    rows = actions(spark, sf).where("action_type = 2")
    return finish(profiles.two_level(rows, "uid", ["day"], {"span": (F.max("us") - F.min("us")) / 1e6}, FIVE), "uid")


@query(finished(f"""WITH {ACTIONS}, d AS (SELECT uid, day, count(*) FILTER (action_type = 1) AS op, count(*) FILTER (action_type = 2) AS trade, count(*) AS total FROM a GROUP BY ALL), e AS (SELECT *, trade / (0.01 + total) AS share FROM d)
 SELECT uid, {stats_sql('op', FIVE)}, {stats_sql('trade', FIVE)}, {stats_sql('total', FIVE)}, {stats_sql('share', FIVE)}, max(total) - min(total) AS total_range FROM e GROUP BY uid""", "uid"))
def user_day_counts(spark, sf):
    days = pivots.count_by(actions(spark, sf), ["uid", "day"], "action_type", {1: "op", 2: "trade"}).withColumn("total", F.col("op") + F.col("trade"))
    days = days.withColumn("share", guarded_ratio("trade", "total"))
    out = [s for c in ("op", "trade", "total", "share") for s in stats(c, FIVE)]
    return finish(days.groupBy("uid").agg(*out, (F.max("total") - F.min("total")).alias("total_range")), "uid")


@query(finished(f"WITH {ACTIONS}, d AS (SELECT uid, dev, (max(us) - min(us)) / 1000000.0 AS span FROM a WHERE dev IS NOT NULL GROUP BY ALL) SELECT uid, {stats_sql('span', FIVE)} FROM d GROUP BY uid", "uid"))
def user_attr_usage_span(spark, sf):
    return finish(profiles.two_level(actions(spark, sf), "uid", ["dev"], {"span": (F.max("us") - F.min("us")) / 1e6}, FIVE), "uid")


# --------------------------------------------------------- entity profiles
@query(finished(f"WITH {ACTIONS}, s AS (SELECT ip, count(DISTINCT uid) AS users FROM a WHERE ip IS NOT NULL GROUP BY ip) SELECT uid, {stats_sql('users', ROLL)} FROM a LEFT JOIN s USING (ip) GROUP BY uid", "uid"))
def attr_popularity_rollup(spark, sf):
    return finish(profiles.profile_rollup(actions(spark, sf), "uid", "ip", [F.count_distinct("uid").alias("users")], ROLL), "uid")


@query(finished(f"WITH {ACTIONS}, s AS (SELECT ip, (max(us) - min(us)) / 1000000.0 AS span FROM a WHERE ip IS NOT NULL GROUP BY ip) SELECT uid, {stats_sql('span', ROLL)} FROM a LEFT JOIN s USING (ip) GROUP BY uid", "uid"))
def attr_active_span_rollup(spark, sf):
    return finish(profiles.profile_rollup(actions(spark, sf), "uid", "ip", [((F.max("us") - F.min("us")) / 1e6).alias("span")], ROLL), "uid")


@query(finished(f"""WITH {ACTIONS}, g AS (SELECT ip, (us - lag(us) OVER (PARTITION BY ip ORDER BY us, event_id)) / 1000000.0 AS gap FROM a WHERE ip IS NOT NULL), s AS (SELECT ip, {stats_sql('gap', ('max', 'min', 'mean', 'std', 'skew'))} FROM g GROUP BY ip)
 SELECT uid, {', '.join(stats_sql(f'gap_{n}', ('max', 'min', 'mean')) for n in ('max', 'min', 'mean', 'std', 'skew'))} FROM a LEFT JOIN s USING (ip) GROUP BY uid""", "uid"))
def attr_interarrival_rollup(spark, sf):
    a = actions(spark, sf)
    gaps = lag_difference(profiles.keyed(a, "ip"), "ip", ["us", "event_id"], "us", "gap").withColumn("gap", F.col("gap") / 1e6)
    profile = gaps.groupBy("ip").agg(*stats("gap", ("max", "min", "mean", "std", "skew")))
    rows = a.select("uid", "ip").join(profile, "ip", "left")
    return finish(rows.groupBy("uid").agg(*(s for n in ("max", "min", "mean", "std", "skew") for s in stats(f"gap_{n}", ("max", "min", "mean")))), "uid")


_MERCHANT = "merchant, count(DISTINCT account) AS accounts, count(DISTINCT channel) AS channels, avg(quantity) AS q_mean, max(quantity) AS q_max, min(quantity) AS q_min, stddev_samp(quantity) AS q_std, avg(day) AS day_mean"
_MERCHANT_COLUMNS = ("accounts", "channels", "q_mean", "q_max", "q_min", "q_std", "day_mean")


@query(finished(f"""WITH {PAYMENTS}, m AS (SELECT {_MERCHANT} FROM p GROUP BY merchant) SELECT uid, {', '.join(stats_sql(c, ('max', 'min', 'sum', 'mean', 'std')) for c in _MERCHANT_COLUMNS)} FROM p JOIN m USING (merchant) GROUP BY uid""", "uid"))
def merchant_profile_rollup(spark, sf):
    profile = [
        F.count_distinct("account").alias("accounts"), F.count_distinct("channel").alias("channels"), F.avg("quantity").alias("q_mean"), F.max("quantity").alias("q_max"),
        F.min("quantity").alias("q_min"), F.stddev_samp("quantity").alias("q_std"), F.avg("day").alias("day_mean"),
    ]
    return finish(profiles.profile_rollup(payments(spark, sf), "uid", "merchant", profile, ("max", "min", "sum", "mean", "std")), "uid")


@query(finished(f"""WITH {PAYMENTS}, m AS (SELECT account, count(DISTINCT merchant) AS merchants, first(amount ORDER BY shipped, orderkey, line) AS amount_first, last(amount ORDER BY shipped, orderkey, line) AS amount_last, avg(quantity) AS q_mean FROM p GROUP BY account)
 SELECT uid, {', '.join(stats_sql(c, ('max', 'min', 'mean')) for c in ('merchants', 'amount_first', 'amount_last', 'q_mean'))} FROM p JOIN m USING (account) GROUP BY uid""", "uid"))
def account_profile_rollup(spark, sf):
    order = F.struct("shipped", "orderkey", "line")
    profile = [F.count_distinct("merchant").alias("merchants"), first_by(F.col("amount"), order).alias("amount_first"), last_by(F.col("amount"), order).alias("amount_last"), F.avg("quantity").alias("q_mean")]
    return finish(profiles.profile_rollup(payments(spark, sf), "uid", "account", profile, ("max", "min", "mean")), "uid")


@query(finished(f"""WITH {PAYMENTS}, m AS (SELECT merchant, avg(amount) AS merchant_mean FROM p GROUP BY merchant) SELECT uid, avg(amount) AS user_mean, avg(merchant_mean) AS merchant_mean, avg(amount) / (0.01 + avg(merchant_mean)) AS ratio FROM p JOIN m USING (merchant) GROUP BY uid""", "uid"))
def user_to_merchant_ratio(spark, sf):
    p = payments(spark, sf)
    rows = p.join(p.groupBy("merchant").agg(F.avg("amount").alias("m")), "merchant")
    return finish(rows.groupBy("uid").agg(F.avg("amount").alias("user_mean"), F.avg("m").alias("merchant_mean"), guarded_ratio(F.avg("amount"), F.avg("m")).alias("ratio")), "uid")


@query(finished(f"""WITH {PAYMENTS}, s AS (SELECT merchant, count(account) AS n, count(DISTINCT account) AS d FROM p GROUP BY merchant) SELECT uid, sum(n) AS merchant_count_sum, sum(d) AS merchant_nunique_sum FROM p JOIN s USING (merchant) GROUP BY uid""", "uid"))
def deliver_two_hop_sum(spark, sf):
    rows = payments(spark, sf)
    return finish(profiles.profile_rollup(rows, "uid", "merchant", [F.count("account").alias("merchant_count"), F.count_distinct("account").alias("merchant_nunique")], ("sum",)), "uid")


@query(finished(f"""WITH {PAYMENTS}, s AS (SELECT merchant, {stats_sql('quantity', ('max', 'min', 'sum', 'mean', 'std'))} FROM p GROUP BY merchant) SELECT uid, {', '.join(f'avg(quantity_{n}) AS quantity_{n}_mean' for n in ('max', 'min', 'sum', 'mean', 'std'))} FROM p JOIN s USING (merchant) GROUP BY uid""", "uid"))
def deliver_two_hop_mean(spark, sf):
    return finish(profiles.profile_rollup(payments(spark, sf), "uid", "merchant", stats("quantity", ("max", "min", "sum", "mean", "std")), ("mean",)), "uid")


# ------------------------------------------------------------------ specs
def _gaps(spark, sf):
    """All actions with the columns that the specs name."""
    rows = lead_gap(actions(spark, sf), "uid", ["us", "event_id"], "us", "time_diff_secd")
    return rows.select(
        "uid", "day", "hour", "time_diff_secd", F.col("mode").alias("channel"), F.col("dev").alias("device2"), "ip", (F.col("k") % 3).alias("os"), (F.col("k") % 5).alias("version"),
        F.nullif(F.col("k") % 4, F.lit(0)).alias("wifi"), F.nullif(F.col("k") % 11, F.lit(0)).alias("market_code"), F.col("k").alias("merchant"), (F.col("k") % 13).alias("device_code"), (F.col("action_type") == 1).cast("int").alias("is_oper"),
    )


_GAPS = f"""WITH {ACTIONS}, g AS (SELECT uid, day, hour, CASE WHEN lead(us) OVER w IS NULL THEN 99999 ELSE CAST(floor((lead(us) OVER w - us) / 1000000.0) AS BIGINT) % 86400 END AS time_diff_secd, mode AS channel, dev AS device2, ip, k % 3 AS os, k % 5 AS version,
 nullif(k % 4, 0) AS wifi, nullif(k % 11, 0) AS market_code, k AS merchant, k % 13 AS device_code, CASE WHEN action_type = 1 THEN 1 ELSE 0 END AS is_oper FROM a WINDOW w AS (PARTITION BY uid ORDER BY us, event_id))"""


def _specs_sql(base: str, table: str, specs, digits: int = 6) -> str:
    """Each spec carried out on its own: filter, group, roll up, join."""
    parts, out = [], []
    for i, s in enumerate(specs):
        name = s.name("uid")
        keys = ", ".join(("uid", *s.keys))
        known = " AND ".join(f"{k} IS NOT NULL" for k in s.keys)
        met = f" AND ({s.where})" if s.where else ""
        if s.agg == "mode":
            inner = f"SELECT {keys}, CASE WHEN count(*) > 1 THEN first(v ORDER BY n DESC, v) END AS v FROM (SELECT {keys}, {s.select} AS v, count(*) AS n FROM {table} WHERE {known}{met} AND {s.select} IS NOT NULL GROUP BY {keys}, {s.select}) GROUP BY {keys}"
        else:
            inner = f"SELECT {keys}, {STATS_SQL[s.agg].format(s.select)} AS v FROM {table} WHERE {known}{met} GROUP BY {keys}"
        parts.append(f"s{i} AS (SELECT uid, max(v) AS {name}_max, min(v) AS {name}_min, avg(v) AS {name}_mean FROM ({inner}) GROUP BY uid)")
        out.append(f"LEFT JOIN s{i} USING (uid)")
    return finished(f"{base}, {', '.join(parts)} SELECT * FROM (SELECT DISTINCT uid FROM {table}) {' '.join(out)}", "uid", digits=digits)


EVENT_SPECS, PAYMENT_SPECS = aggspec.event_specs(), aggspec.payment_specs()


@query(_specs_sql(_GAPS, "g", EVENT_SPECS))
def spec_event_block(spark, sf):
    """All 71 specs on actions, in one aggregation per set of keys."""
    return finish(aggspec.compile_specs(_gaps(spark, sf), "uid", EVENT_SPECS), "uid")


def _moves(spark, sf):
    """Payments with the change of balance and amount against the user's payment before."""
    rows = actions(spark, sf).where("action_type = 2").select("uid", "event_id", "us", "day", "hour", F.col("dev").alias("channel"), F.col("value").alias("amt"), F.col("k").cast("double").alias("bal"))
    for c in ("bal", "amt"):
        rows = lag_difference(rows, "uid", ["us", "event_id"], c, f"{c}_diff").withColumn(f"{c}_diff", F.coalesce(F.col(f"{c}_diff"), F.lit(0.0)))
    up, down = F.greatest(F.col("bal_diff"), F.lit(0.0)), F.least(F.col("bal_diff"), F.lit(0.0))
    return rows.select(
        "uid", "day", "hour", "channel", up.alias("bal_increase"), F.abs("bal_diff").alias("bal_difabs"), F.round(F.greatest(F.col("amt_diff"), F.lit(0.0)), 4).alias("trans_amt_increase"),
        F.round(F.abs("amt_diff"), 4).alias("trans_amt_difabs"), F.try_divide(F.abs(down), "amt").alias("bal_decrease2amt"),
    )


_MOVES = f"""WITH {ACTIONS}, m AS (SELECT uid, day, hour, dev AS channel, value AS amt, coalesce(k - lag(k) OVER w, 0) AS bal_diff, coalesce(value - lag(value) OVER w, 0) AS amt_diff FROM a WHERE action_type = 2 WINDOW w AS (PARTITION BY uid ORDER BY us, event_id)),
 t AS (SELECT uid, day, hour, channel, CAST(greatest(bal_diff, 0) AS DOUBLE) AS bal_increase, CAST(abs(bal_diff) AS DOUBLE) AS bal_difabs, round(greatest(amt_diff, 0.0), 4) AS trans_amt_increase, round(abs(amt_diff), 4) AS trans_amt_difabs, abs(least(bal_diff, 0)) / nullif(amt, 0) AS bal_decrease2amt FROM m)"""


@query(_specs_sql(_MOVES, "t", PAYMENT_SPECS))
def spec_payment_block(spark, sf):
    """All 54 specs on payments."""
    return finish(aggspec.compile_specs(_moves(spark, sf), "uid", PAYMENT_SPECS), "uid")


_RATIOS = (aggspec.RatioSpec("ip"), aggspec.RatioSpec("dev"))


def _ratio_sql(attribute: str) -> str:
    measures = {"mean": "m", "sum": "s", "user_to_mean": "n / m", "user_to_sum": "n / CAST(s AS DOUBLE)"}
    out = ", ".join(f"{r}({e}) AS {attribute}_{m}_{ {'max': 'max', 'min': 'min', 'avg': 'mean'}[r]}" for m, e in measures.items() for r in ("max", "min", "avg"))
    return f"SELECT uid, {out} FROM (SELECT uid, n, avg(n) OVER (PARTITION BY v) AS m, sum(n) OVER (PARTITION BY v) AS s FROM (SELECT uid, {attribute} AS v, count(*) AS n FROM a WHERE {attribute} IS NOT NULL GROUP BY ALL)) GROUP BY uid"


@query(finished(f"WITH {ACTIONS} SELECT * FROM (SELECT DISTINCT uid FROM a) LEFT JOIN ({_ratio_sql('ip')}) USING (uid) LEFT JOIN ({_ratio_sql('dev')}) USING (uid)", "uid"))
def ratio_diffusion(spark, sf):
    return finish(aggspec.compile_ratios(actions(spark, sf), "uid", _RATIOS), "uid")


_SESSIONS = f"""WITH {ACTIONS}, g AS (SELECT *, CASE WHEN lead(us) OVER w IS NULL THEN 99999 ELSE CAST(floor((lead(us) OVER w - us) / 1000000.0) AS BIGINT) END AS gap FROM a WINDOW w AS (PARTITION BY uid ORDER BY us, event_id)),
 s AS (SELECT *, coalesce(sum(CASE WHEN gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session FROM g)"""


@query(finished(f"{_SESSIONS}, n AS (SELECT uid, session, count(DISTINCT dev) AS devs, count(*) AS rows FROM s GROUP BY ALL) SELECT uid, count(*) AS sessions, max(devs) AS devs_max, avg(devs) AS devs_mean, max(rows) AS rows_max FROM n GROUP BY uid", "uid"))
def session_distinct_per_group(spark, sf):
    rows = sessions(actions(spark, sf), "uid", ["us", "event_id"], "us", "session", limit=21_600, within_day=False)
    inner = rows.groupBy("uid", "session").agg(F.count_distinct("dev").alias("devs"), F.count("*").alias("rows"))
    return finish(inner.groupBy("uid").agg(F.count("*").alias("sessions"), F.max("devs").alias("devs_max"), F.avg("devs").alias("devs_mean"), F.max("rows").alias("rows_max")), "uid")


# ----------------------------------------------------------------- pivots
@query(finished(f"""WITH {ACTIONS} SELECT uid, count(*) FILTER (success = -1) AS unknown, count(*) FILTER (success = 0) AS failed, count(*) FILTER (success = 1) AS ok,
 count(*) FILTER (success = 1) - count(*) FILTER (success = 0) AS diff, count(*) FILTER (success = 0) / (0.01 + count(*) FILTER (success = 1)) AS failed_to_ok FROM a GROUP BY uid""", "uid"))
def pivot_success(spark, sf):
    rows = pivots.count_by(actions(spark, sf), ["uid"], "success", {-1: "unknown", 0: "failed", 1: "ok"})
    return finish(rows.withColumns({"diff": F.col("ok") - F.col("failed"), "failed_to_ok": guarded_ratio("failed", "ok")}), "uid")


@query("""SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_custkey""")
def pivot_channel(spark, sf):
    return pivots.count_by(load(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", {"1-URGENT": "urgent", "5-LOW": "low"})


@query(finished(f"""WITH {PAYMENTS}, q AS (SELECT uid, CASE WHEN market IS NULL THEN 'nomarket' ELSE 'market' END AS m, amount FROM p), v AS (SELECT uid, count(*) FILTER (m = 'market') AS market_n, avg(amount) FILTER (m = 'market') AS market_mean, count(*) FILTER (m = 'nomarket') AS nomarket_n, avg(amount) FILTER (m = 'nomarket') AS nomarket_mean FROM q GROUP BY uid)
 SELECT uid, nullif(market_n, 0) AS market_n, market_mean, nullif(nomarket_n, 0) AS nomarket_n, nomarket_mean, nullif(market_n, 0) - nullif(nomarket_n, 0) AS n_diff, market_mean / (0.01 + nomarket_mean) AS mean_ratio FROM v""", "uid"))
def pivot_market_multi(spark, sf):
    rows = payments(spark, sf).withColumn("m", F.when(F.col("market").isNull(), "nomarket").otherwise("market"))
    out = pivots.aggregate_by(rows, "uid", "m", {"market": "market", "nomarket": "nomarket"}, {"n": F.count("amount"), "mean": F.avg("amount")})
    return finish(out.withColumns({"n_diff": F.col("market_n") - F.col("nomarket_n"), "mean_ratio": guarded_ratio("market_mean", "nomarket_mean")}), "uid")


@query(finished(f"""WITH {ACTIONS}, p AS (SELECT uid, count(*) FILTER (action_type = 2) AS trades FROM a GROUP BY uid), h AS (SELECT uid, avg(hour) AS hour_mean FROM a GROUP BY uid), d AS (SELECT uid, count(DISTINCT day) AS days FROM a WHERE action_type = 2 GROUP BY uid)
 SELECT uid, trades, hour_mean, days FROM p LEFT JOIN h USING (uid) LEFT JOIN d USING (uid)""", "uid"))
def feature_frame(spark, sf):
    """Feature families joined on the user: each family is one aggregation, each join has the same key."""
    a = actions(spark, sf)
    trades = a.groupBy("uid").agg(F.count_if(F.col("action_type") == 2).alias("trades"))
    hours = a.groupBy("uid").agg(F.avg("hour").alias("hour_mean"))
    days = a.where("action_type = 2").groupBy("uid").agg(F.count_distinct("day").alias("days"))
    return finish(attach(trades, hours, days, key="uid"), "uid")
