"""Queries on text, rules, measures and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import learn, rules, scores, text
from riskloom.operators.boosting import NewtonTrees
from riskloom.plans.registry import PAYMENTS, finish, finished, finished_all, query
from riskloom.sources.tables import actions, load, payments

# ------------------------------------------------------------------- text
_TERMS = "w AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}') AS tokens FROM conversations), u AS (SELECT conv_id, turn, unnest(tokens) AS term FROM w), c AS (SELECT conv_id, turn, term, count(*) AS tf FROM u GROUP BY ALL)"


def _docs(spark, sf):
    """All turns, each under its conversation and number."""
    rows = load(spark, sf, "conversations")
    return rows.select(F.struct("conv_id", "turn").alias("doc"), text.words(F.col("text")).alias("tokens"))


@query(f"WITH {_TERMS} SELECT conv_id, turn, term, tf FROM c")
def bow_counts(spark, sf):
    return text.term_counts(_docs(spark, sf), "doc", "tokens").select("doc.conv_id", "doc.turn", "term", "tf")


@query(finished(f"""WITH {_TERMS}, n AS (SELECT count(*) AS n FROM w), d AS (SELECT term, ln((1 + n) / (1.0 + count(*))) + 1 AS idf FROM c, n GROUP BY term, n), x AS (SELECT conv_id, turn, term, tf * idf AS w FROM c JOIN d USING (term))
 SELECT conv_id, turn, term, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn)) AS weight FROM x""", "conv_id", "turn", "term"))
def tfidf_l2(spark, sf):
    docs = _docs(spark, sf)
    weights = text.tf_idf(text.term_counts(docs, "doc", "tokens"), "doc", docs)
    return finish(weights.select("doc.conv_id", "doc.turn", "term", "weight"), "conv_id", "turn", "term")


@query(f"""WITH {_TERMS}, p AS (SELECT conv_id, turn, unnest(list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))) AS term FROM w), q AS (SELECT DISTINCT conv_id, turn, term FROM p)
 SELECT term, count(*) AS df FROM q GROUP BY term HAVING count(*) >= 5 AND count(*) <= 0.8 * (SELECT count(*) FROM w)""")
def ngram_df(spark, sf):
    docs = _docs(spark, sf)
    counts = text.term_counts(docs, "doc", text.with_pairs(F.col("tokens")))
    return text.kept_terms(counts, docs.count(), 5, 0.8)


@query()
def w2v_user_features(spark, sf):
    """Mean and skew of each dimension of a user's word vectors."""
    return text.sequence_vectors(actions(spark, sf), "uid", "dev", ["us", "event_id"], size=4)


@query()
def row2vec_features(spark, sf):
    """Four statistics of each dimension of the vectors of a user's values, by column."""
    return text.row_vectors(actions(spark, sf), "uid", ["mode", "dev", "hour"], size=4, iterations=2)


# ------------------------------------------------------------------ rules
_BAD = "b AS (SELECT c_custkey AS uid, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS bad FROM customer)"
_RATES = f"WITH {PAYMENTS}, {_BAD}, r AS (SELECT account, count(DISTINCT CASE WHEN bad = 1 THEN uid END) / CAST(count(DISTINCT uid) AS DOUBLE) AS ratio, count(DISTINCT uid) AS support FROM p JOIN b USING (uid) GROUP BY account)"


def _marked(spark, sf):
    bad = load(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), (F.col("c_acctbal") < 0).alias("bad"))
    return payments(spark, sf).join(bad, "uid")


def _rates(spark, sf):
    return rules.attribute_rates(_marked(spark, sf), "uid", "account", F.col("bad"))


@query(finished(f"{_RATES} SELECT account, ratio, support FROM r WHERE ratio >= 0.2 AND support >= 5", "account"))
def label_black_rate(spark, sf):
    return finish(rules.rule_values(_rates(spark, sf), 0.2, 5), "account")


@query(finished(f"{_RATES.replace('bad = 1', 'bad = 0')} SELECT account, ratio, support FROM r WHERE ratio >= 1 AND support >= 20", "account"))
def label_white_rate(spark, sf):
    rates = rules.attribute_rates(_marked(spark, sf), "uid", "account", ~F.col("bad"))
    return finish(rules.rule_values(rates, 1.0, 20), "account")


@query(f"{_RATES} SELECT DISTINCT uid FROM p WHERE account IN (SELECT account FROM r WHERE ratio >= 0.25 AND support >= 5) UNION SELECT DISTINCT uid FROM p WHERE account IN (SELECT account FROM r WHERE ratio >= 0.2 AND support >= 20)")
def rule_hits_union(spark, sf):
    p, rates = payments(spark, sf), _rates(spark, sf)
    found = [rules.users_with(p, "uid", "account", rules.rule_values(rates, *t)) for t in ((0.25, 5), (0.2, 20))]
    return found[0].union(found[1]).distinct()


@query(f"""{_RATES}, s AS (SELECT c_custkey AS uid, c_acctbal / 10000.0 AS score FROM customer), l AS (SELECT min(score) AS lo, max(score) AS hi FROM s),
 many AS (SELECT account FROM p GROUP BY account HAVING count(DISTINCT uid) > 34), burst AS (SELECT merchant FROM p GROUP BY merchant HAVING count(DISTINCT uid) > 70 AND count(DISTINCT day) < 31)
 SELECT uid, round(CASE WHEN uid IN (SELECT uid FROM p WHERE account IN (SELECT account FROM many)) THEN hi WHEN uid IN (SELECT uid FROM p WHERE merchant IN (SELECT merchant FROM burst)) THEN hi
 WHEN uid IN (SELECT uid FROM p WHERE channel = '5-LOW' AND quantity > 49) THEN lo ELSE score END, 6) AS score FROM s, l""")
def rule_override(spark, sf):
    """Three rules in turn: a channel lowers the score, a burst of users on a merchant and a widely shared account raise it."""
    p = payments(spark, sf)
    base = rules.with_limits(load(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), (F.col("c_acctbal") / 10000.0).alias("score")), "score")
    low = p.where("channel = '5-LOW' and quantity > 49").select("uid")
    burst = rules.shared_values(p, "merchant", {"u": F.count_distinct("uid"), "d": F.count_distinct("day")}, (F.col("u") > 70) & (F.col("d") < 31))
    many = rules.shared_values(p, "account", {"u": F.count_distinct("uid")}, F.col("u") > 34)
    steps = [(low, F.col("lowest")), (rules.users_with(p, "uid", "merchant", burst), F.col("highest")), (rules.users_with(p, "uid", "account", many), F.col("highest"))]
    return rules.overridden(base, "uid", "score", steps).select("uid", F.round("score", 6).alias("score"))


@query(f"WITH {PAYMENTS} SELECT account, count(DISTINCT uid) AS users FROM p GROUP BY account HAVING count(DISTINCT uid) > 30")
def popularity_rule(spark, sf):
    return rules.shared_values(payments(spark, sf), "account", {"users": F.count_distinct("uid")}, F.col("users") > 30)


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS n, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) > 12 AND count(DISTINCT o_orderpriority) < 5")
def burst_rule(spark, sf):
    return rules.shared_values(load(spark, sf, "orders"), "o_custkey", {"n": F.count_distinct("o_orderkey"), "kinds": F.count_distinct("o_orderpriority")}, (F.col("n") > 12) & (F.col("kinds") < 5))


@query(finished_all("SELECT count(*) AS hits, count(*) FILTER (c_acctbal < 0) AS marked, count(*) FILTER (c_acctbal < 0) / CAST(count(*) AS DOUBLE) AS precision FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)"))
def rule_report(spark, sf):
    hits = load(spark, sf, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return finish(rules.rule_report(load(spark, sf, "customer"), hits, "c_custkey", F.col("c_acctbal") < 0))


# --------------------------------------------------------------- measures
_SCORED = "s AS (SELECT o_orderkey AS id, o_totalprice AS score, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS y FROM orders)"


def _scored(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))


@query(f"""WITH {_SCORED}, r AS (SELECT y, row_number() OVER (ORDER BY score DESC, id) AS place, sum(y) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS tp FROM s), t AS (SELECT sum(y) AS p, count(*) AS n FROM s),
 f AS (SELECT place, tp / CAST(p AS DOUBLE) AS tpr, (place - tp) / CAST(n - p AS DOUBLE) AS fpr FROM r, t)
 SELECT round(CAST(CAST(0.4 * (SELECT tpr FROM f ORDER BY abs(fpr - 0.001), place LIMIT 1) + 0.3 * (SELECT tpr FROM f ORDER BY abs(fpr - 0.005), place LIMIT 1) + 0.3 * (SELECT tpr FROM f ORDER BY abs(fpr - 0.01), place LIMIT 1) AS FLOAT) AS DOUBLE), 8) AS weighted_tpr""")
def weighted_tpr(spark, sf):
    return finish(scores.weighted_tpr(_scored(spark, sf), "score", "y", "id"), digits=8)


@query(f"""WITH {_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS place FROM s)
 SELECT round(CAST(CAST((sum(place) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * CAST(count(*) - sum(y) AS DOUBLE)) AS FLOAT) AS DOUBLE), 8) AS auc FROM r""")
def auc_rank_sum(spark, sf):
    return finish(scores.auc(_scored(spark, sf), "score", "y"), digits=8)


@query(f"WITH {_SCORED}, p AS (SELECT y, least(greatest(score / 600000, 1e-15), 1 - 1e-15) AS p FROM s) SELECT round(CAST(CAST(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END) AS FLOAT) AS DOUBLE), 8) AS log_loss FROM p")
def logloss(spark, sf):
    return finish(scores.log_loss(_scored(spark, sf).withColumn("p", F.col("score") / 600000), "p", "y"), digits=8)


@query("SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY o_orderpriority")
def class_counts(spark, sf):
    return load(spark, sf, "orders").groupBy("o_orderpriority").count().orderBy(F.desc("count"), "o_orderpriority")


# ----------------------------------------------------------------- models
def _features(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), (F.col("c_acctbal") < 0).cast("int").alias("tag"), F.col("c_nationkey").cast("double").alias("nation"))
    o = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("uid")).agg(F.count("*").cast("double").alias("n"), F.avg("o_totalprice").alias("price"), F.stddev_samp("o_totalprice").alias("spread"))
    return c.join(o, "uid", "left")


@query("SELECT tag, fold_rows, count(*) AS folds FROM (SELECT CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS tag, ntile(5) OVER (PARTITION BY c_acctbal < 0 ORDER BY c_custkey) AS f, c_custkey FROM customer) JOIN (SELECT tag AS t, f AS g, count(*) AS fold_rows FROM (SELECT CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS tag, ntile(5) OVER (PARTITION BY c_acctbal < 0 ORDER BY c_custkey) AS f FROM customer) GROUP BY ALL) ON tag = t AND f = g GROUP BY ALL")
def stratified_folds(spark, sf):
    """How many users share a label and a fold size: equal shares within each label."""
    rows = learn.with_folds(_features(spark, sf), "uid", "tag", 5)
    return rows.groupBy("tag", "fold").agg(F.count("*").alias("fold_rows")).groupBy("tag", "fold_rows").agg(F.sum("fold_rows").alias("folds"))


_COLUMNS = ["nation", "n", "price", "spread"]


@query(finished("SELECT c_custkey AS uid, 0.5 * c_acctbal + 0.26 * c_nationkey + 0.24 * c_custkey AS score FROM customer", "uid"))
def blend_weighted(spark, sf):
    c = load(spark, sf, "customer").withColumnRenamed("c_custkey", "uid")
    parts = {name: (c.select("uid", F.col(col).cast("double").alias("score")), w) for name, col, w in (("a", "c_acctbal", 0.5), ("b", "c_nationkey", 0.26), ("c", "uid", 0.24))}
    return finish(learn.blended(parts, "uid", "score"), "uid")


@query(finished("SELECT c_custkey AS uid, (c_acctbal + c_nationkey) / 2 AS score FROM customer", "uid"))
def oof_mean(spark, sf):
    c = load(spark, sf, "customer").withColumnRenamed("c_custkey", "uid")
    return finish(learn.mean_by_key([c.select("uid", F.col("c_acctbal").alias("score")), c.select("uid", F.col("c_nationkey").cast("double").alias("score"))], "uid", "score"), "uid")


@query(finished("""WITH x AS (SELECT o_custkey % 7 = 0 AS y, floor((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 15 / count(*) OVER ()) AS bin FROM orders), c AS (SELECT bin, count(*) FILTER (NOT y) AS goods, count(*) FILTER (y) AS bads FROM x GROUP BY bin),
 t AS (SELECT *, (goods + 0.5) / sum(goods) OVER () AS g, (bads + 0.5) / sum(bads) OVER () AS b FROM c) SELECT CAST(bin AS INT) AS bin, goods, bads, ln(g / b) AS woe, (g - b) * ln(g / b) AS iv_part FROM t""", "bin"))
def iv_by_bins(spark, sf):
    rows = load(spark, sf, "orders").withColumn("y", (F.col("o_custkey") % 7 == 0).cast("int"))
    return finish(learn.information_value(rows, "o_totalprice", "y", "o_orderkey"), "bin")


@query(finished("SELECT o_orderkey, coalesce(x, (SELECT median(x) FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS x FROM orders))) AS x FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS x FROM orders)", "o_orderkey"))
def median_impute(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("x"))
    return finish(learn.median_filled_exact(rows, ["x"]), "o_orderkey")


@query()
def gbt_cv(spark, sf):
    """Out-of-fold scores of boosted trees over stratified folds."""
    rows = learn.with_folds(_features(spark, sf).fillna(0.0), "uid", "tag", 3)
    return learn.out_of_fold(rows, "uid", _COLUMNS, "tag", lambda: learn.boosted(rounds=3, depth=3), 3)[0]


@query()
def gbt_early_stopping(spark, sf):
    """As gbt_cv, but a fold's rounds end where its own loss no longer falls."""
    rows = learn.with_folds(_features(spark, sf).fillna(0.0), "uid", "tag", 2)
    return learn.out_of_fold(rows, "uid", _COLUMNS, "tag", lambda: learn.boosted(rounds=8, depth=2, stop_early=True), 2)[0]


@query()
def gbt_sampled(spark, sf):
    """Out-of-fold scores of Newton-boosted trees that sample rows by gradient."""
    rows = learn.with_folds(_features(spark, sf).fillna(0.0), "uid", "tag", 2)
    return learn.out_of_fold(rows, "uid", _COLUMNS, "tag", lambda: NewtonTrees(rounds=4, depth=3, top=0.2, other=0.1), 2)[0]


@query()
def topk_importance(spark, sf):
    rows = learn.with_folds(_features(spark, sf).fillna(0.0), "uid", "tag", 2)
    return learn.top_features(learn.out_of_fold(rows, "uid", _COLUMNS, "tag", lambda: learn.forest(trees=5, depth=3), 2)[1])


@query()
def stacking(spark, sf):
    rows = learn.with_folds(_features(spark, sf).fillna(0.0), "uid", "tag", 2)
    models = {"gbt": lambda: learn.boosted(rounds=2, depth=2), "rf": lambda: learn.forest(trees=3, depth=3), "extra": lambda: learn.forest(trees=3, depth=3, bootstrap=False)}
    return learn.stacked(rows, "uid", _COLUMNS, "tag", models, lambda: learn.boosted(rounds=2, depth=2), 2)


@query()
def pca_embeddings(spark, sf):
    return learn.principal_components(load(spark, sf, "embeddings"), "vec_id", "embedding", 8)


@query()
def parameter_ensemble(spark, sf):
    """The mean of two parameter sets' out-of-fold scores."""
    rows = learn.with_folds(_features(spark, sf).fillna(0.0), "uid", "tag", 2)
    return learn.ensemble(rows, "uid", _COLUMNS, "tag", [lambda: learn.boosted(rounds=2, depth=2), lambda: learn.forest(trees=3, depth=3)], 2)
