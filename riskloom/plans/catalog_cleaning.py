"""Queries on cleaning, unions, joins and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import arrays, scalar, times
from riskloom.operators import relational
from riskloom.plans.registry import ACTIONS, finish, finished, query
from riskloom.sources.files import word_counts
from riskloom.sources.tables import actions, load


@query(f"WITH {ACTIONS} SELECT event_id, uid, mode FROM a WHERE mode = 'purchase' UNION ALL SELECT event_id, uid, mode FROM a WHERE mode = 'error'")
def union_same_schema(spark, sf):
    a = actions(spark, sf).select("event_id", "uid", "mode")
    return relational.union_all(a.where("mode = 'purchase'"), a.where("mode = 'error'"))


@query(f"WITH {ACTIONS} SELECT event_id, uid, value, NULL::INT AS ip FROM a WHERE action_type = 2 UNION ALL SELECT event_id, uid, NULL, ip FROM a WHERE action_type = 1")
def union_by_schema_union(spark, sf):
    a = actions(spark, sf)
    return relational.union_filled(a.where("action_type = 2").select("event_id", "uid", "value"), a.where("action_type = 1").select("event_id", "uid", "ip"))


@query(f"WITH {ACTIONS} SELECT event_id, uid FROM a")
def union_by_schema_intersection(spark, sf):
    a = actions(spark, sf)
    return relational.union_common(a.where("action_type = 2").select("event_id", "uid", "value"), a.where("action_type = 1").select("event_id", "ip", "uid"))


@query("""SELECT p_partkey, nullif(concat(coalesce(a, ''), coalesce(b, ''), coalesce(c, '')), '') AS joined, coalesce(a, b, c) AS first_known,
 CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 1 WHEN c IS NOT NULL THEN 2 ELSE -1 END AS kind
 FROM (SELECT p_partkey, nullif(p_brand, 'Brand#1') AS a, nullif(p_type, 'ECONOMY') AS b, CASE WHEN p_size > 10 THEN p_name END AS c FROM part)""")
def clean_codes(spark, sf):
    rows = load(spark, sf, "part").select(
        "p_partkey", F.nullif("p_brand", F.lit("Brand#1")).alias("a"), F.nullif("p_type", F.lit("ECONOMY")).alias("b"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("c")
    )
    return rows.select("p_partkey", scalar.joined_codes("a", "b", "c").alias("joined"), scalar.first_known("a", "b", "c").alias("first_known"), scalar.device_kind("a", "b", "c").alias("kind"))


@query(f"""WITH {ACTIONS} SELECT event_id, CASE WHEN ip IS NULL THEN -1 WHEN ip = 7 THEN 1 ELSE 0 END AS is_seven,
 CASE WHEN ip IS NOT NULL AND dev IS NOT NULL THEN 3 WHEN ip IS NOT NULL THEN 2 WHEN dev IS NOT NULL THEN 1 ELSE -1 END AS presence,
 CASE WHEN dev IS NULL THEN 1 ELSE 0 END AS no_dev, CASE WHEN ip IS NOT NULL THEN 'market' ELSE 'nomarket' END AS market,
 (CASE WHEN ip IS NULL THEN 1 ELSE 0 END) + (CASE WHEN dev IS NULL THEN 1 ELSE 0 END) AS missing FROM a""")
def clean_presence_codes(spark, sf):
    return actions(spark, sf).select(
        "event_id", scalar.equals_flag("ip", 7).alias("is_seven"), scalar.pair_presence("ip", "dev").alias("presence"), scalar.null_flag("dev").alias("no_dev"),
        scalar.presence_label("ip", "market", "nomarket").alias("market"), scalar.null_count("ip", "dev").alias("missing"),
    )


_CLASSES = {"tools": ("widget", "gear"), "jewels": ("ring", "red r"), "colour": ("red", "blue")}


@query("""SELECT p_partkey, CASE WHEN n IS NULL OR n = 'nan' THEN '-1' WHEN contains(n, 'red') OR contains(n, 'blue') THEN 'colour'
 WHEN contains(n, 'ring') OR contains(n, 'red r') THEN 'jewels' WHEN contains(n, 'widget') OR contains(n, 'gear') THEN 'tools' ELSE 'others' END AS brand
 FROM (SELECT p_partkey, CASE WHEN p_size > 3 THEN p_name END AS n FROM part)""")
def clean_brand_classifier(spark, sf):
    rows = load(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 3, F.col("p_name")).alias("n"))
    return rows.select("p_partkey", scalar.last_match("n", _CLASSES).alias("brand"))


@query(f"WITH {ACTIONS} SELECT event_id, coalesce(ip, -1) AS ip, coalesce(CASE WHEN mode <> 'view' THEN mode END, '-1') AS mode FROM a")
def clean_fill_by_type(spark, sf):
    rows = actions(spark, sf).select("event_id", "ip", F.when(F.col("mode") != "view", F.col("mode")).alias("mode"))
    return scalar.filled(rows)


@query(f"""WITH {ACTIONS} SELECT event_id, strftime(DATE '2018-08-31' + CAST(d AS INT), '%Y-%m-%d') AS date, CAST(epoch(DATE '2018-08-31' + CAST(d AS INT)) AS BIGINT) + hour * 3600 AS seconds,
 hour AS hour_of_text, CAST(epoch(DATE '2018-10-31' + CAST(day AS INT)) AS BIGINT) + hour * 3600 + 330 AS moment FROM (SELECT *, day + 30 AS d FROM a)""")
def clean_day_axis(spark, sf):
    text = F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":05:30"))
    rows = actions(spark, sf).select("event_id", (F.col("day") + 30).alias("d"), "day", text.alias("time"))
    midnight = times.at_time("2018-08-31", F.col("d"), F.lit("00:00:00"))
    return rows.select(
        "event_id", times.day_of_base("2018-08-31", F.col("d")).alias("date"),
        (times.epoch_seconds(midnight) + times.hour_of_text(F.col("time")) * 3600).alias("seconds"), times.hour_of_text(F.col("time")).alias("hour_of_text"),
        times.epoch_seconds(times.at_time("2018-10-31", F.col("day"), F.col("time"))).alias("moment"),
    )


@query("""WITH v AS (SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'nan') AS t FROM orders), c AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS code FROM (SELECT DISTINCT t FROM v))
 SELECT o_orderkey, code + 1000000 AS code FROM v JOIN c USING (t)""")
def clean_label_encode(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return relational.label_codes(rows, "p", "code", 1_000_000).select("o_orderkey", F.col("code").cast("long"))


@query(finished(f"""WITH {ACTIONS} SELECT event_id, greatest(value - 50, 0) AS up, least(value - 50, 0) AS down, abs(value - 50) AS size, k / (0.01 + hour) AS guarded,
 CASE WHEN hour = 0 THEN NULL ELSE k / CAST(hour AS DOUBLE) END AS plain, 0.5 * value + 0.26 * k + 0.24 * hour AS blend, CASE WHEN hour < 3 THEN 0 ELSE value END AS replaced FROM a""", "event_id"))
def clean_numeric_parts(spark, sf):
    rows = actions(spark, sf).withColumn("x", F.col("value") - 50)
    return finish(rows.select(
        "event_id", scalar.positive_part("x").alias("up"), scalar.negative_part("x").alias("down"), F.abs("x").alias("size"), scalar.guarded_ratio("k", "hour").alias("guarded"),
        scalar.ratio("k", "hour").alias("plain"), scalar.weighted_sum({"value": 0.5, "k": 0.26, "hour": 0.24}).alias("blend"), scalar.replaced_where(F.col("hour") < 3, F.lit(0.0), "value").alias("replaced"),
    ), "event_id")


@query(f"""WITH {ACTIONS} SELECT event_id, upper(substr(mode, 1, 2)) AS head, list_extract(string_split(strftime(ts, '%H:%M:%S'), ':'), 2) AS minute, replace(mode, 'i', '') AS replaced,
 concat_ws('_', mode, coalesce(CAST(dev AS VARCHAR), 'nan')) AS joined, contains(mode, 'ur') AS has FROM a""")
def scalar_strings(spark, sf):
    return actions(spark, sf).select(
        "event_id", F.upper(F.substring("mode", 1, 2)).alias("head"), F.split(F.date_format("ts", "HH:mm:ss"), ":")[1].alias("minute"), F.replace("mode", F.lit("i"), F.lit("")).alias("replaced"),
        F.concat_ws("_", "mode", scalar.text_token("dev")).alias("joined"), F.contains("mode", F.lit("ur")).alias("has"),
    )


@query("""SELECT c_custkey, n_name AS province, r_name AS nation, CASE WHEN r_name IS NULL THEN -1 WHEN r_name = 'ASIA' THEN 1 ELSE 0 END AS is_home
 FROM customer LEFT JOIN nation ON nullif(c_nationkey, 3) = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def dim_geo_join(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("code"))
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    geo = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("province"), F.col("r_name").alias("nation"))
    return c.join(geo, "code", "left").select("c_custkey", "province", "nation", scalar.equals_flag("nation", "ASIA").alias("is_home"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_bad_users(spark, sf):
    bad = load(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return relational.rows_with_ids(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), bad, "o_custkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 1 ELSE 0 END AS large FROM customer""")
def flagged_members(spark, sf):
    large = load(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return relational.flagged(load(spark, sf, "customer").select("c_custkey"), large, "c_custkey", "large")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 100000 AND o_custkey <= 700 AND nullif(o_orderstatus, 'P') IS NOT NULL")
def filters_combined(spark, sf):
    o = load(spark, sf, "orders")
    kept = o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).where("o_totalprice >= 100000 and o_custkey <= 700")
    return kept.where(F.nullif("o_orderstatus", F.lit("P")).isNotNull()).select("o_orderkey")


@query(f"WITH {ACTIONS} SELECT DISTINCT uid, mode FROM a")
def drop_duplicate_rows(spark, sf):
    return actions(spark, sf).select("uid", "mode").dropDuplicates()


@query(f"WITH {ACTIONS} SELECT uid, dev FROM a WHERE mode = 'click' AND dev IS NOT NULL UNION SELECT uid, dev FROM a WHERE mode = 'view' AND dev IS NOT NULL")
def union_of_id_sets(spark, sf):
    a = actions(spark, sf).where("dev is not null")
    return relational.union_all(a.where("mode = 'click'").select("uid", "dev"), a.where("mode = 'view'").select("uid", "dev")).distinct()


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def dedupe_columns(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey", F.col("c_nationkey").alias("again"), "c_acctbal", F.col("c_acctbal").alias("more"))
    return relational.without_equal_columns(c, "c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_fifty(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(trim(text), '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def count_words(spark, sf):
    return word_counts(load(spark, sf, "documents"), F.col("text"))


@query("SELECT uid, CAST(i AS INT) AS place, list_extract(l, i * 3 + 1) AS a, list_extract(l, i * 3 + 2) AS b, list_extract(l, i * 3 + 3) AS c FROM (SELECT user_id AS uid, list(event_id ORDER BY event_id) AS l FROM events GROUP BY 1), generate_series(0, 1000000) AS g(i) WHERE i * 3 < len(l)")
def chunk_array(spark, sf):
    lists = actions(spark, sf).groupBy("uid").agg(F.array_sort(F.collect_list("event_id")).alias("l"))
    cut = lists.select("uid", F.posexplode(arrays.chunks(F.col("l"), 3)).alias("place", "c"))
    return cut.select("uid", "place", F.col("c")[0].alias("a"), F.col("c")[1].alias("b"), F.col("c")[2].alias("c"))
