"""URL filters from listed rules and from mined association rules.

Listed rules name a host, with all its subdomains, and the start of a path;
the longest that fits decides.  For other urls the method decides: FP-growth
mines sets of url tokens that go with bad labels, rules are pruned by support
and confidence, and a url is blocked if it holds all tokens of a rule.  Rules
are found by an inverted index: each stands under its rarest token only, and
a url meets the rules of its own tokens.  Everything is DataFrame work.

Tokens that always come together (site, host labels and path parts of one
template) would give two to the power of their number of equal sets.  So
mining sees classes of tokens that stand in the same rows, one item each;
tokens of too few bad rows, and tokens of all rows, are no items; a class that
is a rule by itself is none either, as a larger set with it blocks nothing
more.  Of what is left FP-growth sees a row's ``MOST`` classes with the largest
bad shares.  That counts in full each set that no row with more classes holds;
the sets that such a long row holds are searched by levels over whole rows
instead, where only free sets grow: those that fewer rows hold than each of
their subsets, as a rule has the rows of a free set in it.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import broadcast_if_small, table
from riskloom.sources.storage import materialise

#: The rules of the query, as (verdict, host/path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
MIN_ROWS = 30
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.5
MOST = 12
BAD = "label:bad"
_RULE = "antecedent array<string>, confidence double, support long, anchor string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty if it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def listed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null.  Two rules of
    one length that fit are the same text; the one listed last decides."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        own_host, slash, own_path = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, action).otherwise(verdict)
    return text, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: scheme, host labels, host, path parts and
    parameter names; numbers count as one token."""
    said = F.coalesce(url, F.lit(""))

    def parts(text: Column, cut: str, kind: str) -> Column:
        plain = F.transform(F.split(F.translate(text, _UPPER, _LOWER), cut), lambda x: F.regexp_replace(x, r"[0-9]+", "0"))
        return F.transform(F.filter(plain, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))

    query = F.regexp_extract(said, r"\?([^#]*)", 1)
    names = F.array_join(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^[^=]*", 0)), "&")
    whole = F.filter(F.array(F.concat(F.lit("site:"), host)), lambda x: x != "site:")
    scheme = F.regexp_extract(said, r"^([^:/?#]*)://", 1)
    return F.array_distinct(F.concat(parts(scheme, "-", "scheme"), whole, parts(host, r"[.\-]", "host"), parts(path, "/", "path"), parts(names, "&", "key")))


def _classes(taught: DataFrame, rows: int, min_rows: int) -> DataFrame:
    """(token, class, n, n_bad): tokens of ``min_rows`` bad rows or more, but
    not of all rows; tokens that stand in the same rows (by number and sums of
    row hashes) share a class, named after the smallest."""
    mark = F.xxhash64("row")
    counted = (
        taught.select(F.explode("tokens").alias("token"), "bad", mark.alias("mark")).groupBy("token")
        .agg(
            F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), F.bit_xor("mark").alias("mixed"),
            F.sum(F.col("mark").bitwiseAND(F.lit(0xFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned("mark", 40)).alias("high"),
        ).where((F.col("n_bad") >= min_rows) & (F.col("n") < rows))
    )
    same = ["n", "n_bad", "mixed", "low", "high"]
    names = counted.groupBy(*same).agg(F.min("token").alias("class"))
    return materialise(counted.join(names, same).select("token", "class", "n", "n_bad"), "url-tokens")


def _held_classes(rows: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Per key, from (key, tokens) rows: ``pairs``, the (class, token) of its known tokens."""
    exploded = rows.select(*keys, F.explode("tokens").alias("token"))
    return exploded.join(broadcast_if_small(known), "token").groupBy(*keys).agg(F.collect_set(F.struct("class", "token")).alias("pairs"))


def _holding(sets: DataFrame, rules: DataFrame, *keep: str) -> DataFrame:
    """``sets`` (classes, ...) with each rule they hold, by the inverted index."""
    anchored = sets.select(*keep, "classes", F.explode("classes").alias("anchor")).join(broadcast_if_small(rules), "anchor")
    return anchored.where(F.size(F.array_except("antecedent", "classes")) == 0)


def _rest(sets: DataFrame, known: DataFrame, longest: int, least: float, min_rows: int) -> DataFrame:
    """(antecedent): the smallest rules of two classes or more that rows with
    more than ``MOST`` classes hold, counted over all rows."""
    alike = sets.groupBy(F.array_sort("classes").alias("classes")).agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"))
    shapes = materialise(alike.select(F.monotonically_increasing_id().alias("shape"), "classes", "n", "n_bad", (F.size("classes") > MOST).alias("long")), "url-shapes")
    first = known.select(F.col("class").alias("last"), "n").distinct()
    seen = shapes.where("long").select(F.explode("classes").alias("last")).distinct()
    open_sets = materialise(first.join(seen, "last", "left_semi").select(F.array("last").alias("set"), "n"), "url-open")
    held = shapes.select("shape", "n", "n_bad", "long", F.explode("classes").alias("last")).withColumn("set", F.array("last"))
    rules = None
    for size in range(2, longest + 1):
        own = ["shape", "n", "n_bad", "long"]
        held = held.join(broadcast_if_small(open_sets.select("set")), "set", "left_semi")
        groups = held.groupBy(*own, F.slice("set", 1, size - 2).alias("prefix")).agg(F.array_sort(F.collect_list(F.element_at("set", -1))).alias("lasts"))
        one = groups.where(F.size("lasts") > 1).select(*own, "prefix", "lasts", F.posexplode("lasts").alias("i", "one"))
        two = one.select(*own, F.array_append("prefix", F.col("one")).alias("prefix"), F.explode(F.expr("slice(lasts, i + 2, size(lasts))")).alias("last"))
        held = materialise(two.select(*own, F.array_append("prefix", F.col("last")).alias("set")), "url-held")
        counted = held.groupBy("set").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"), F.bool_or("long").alias("long")).where((F.col("n_bad") >= min_rows) & F.col("long"))
        subset = F.explode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.filter("set", lambda _, j: j != i))).alias("subset")
        within = counted.select("set", "n", "n_bad", subset).join(open_sets.select(F.col("set").alias("subset"), F.col("n").alias("more")), "subset")
        free = within.groupBy("set", "n", "n_bad").agg(F.count("*").alias("subsets"), F.min("more").alias("more")).where((F.col("subsets") == size) & (F.col("n") < F.col("more")))
        free = materialise(free.select("set", "n", (F.col("n_bad") / F.col("n") >= least).alias("rule")), "url-free")
        found = free.where("rule").select(F.col("set").alias("antecedent"))
        rules = found if rules is None else rules.unionAll(found)
        open_sets = free.where("NOT rule").select("set", "n")
        if open_sets.isEmpty():
            break
    return rules


def _larger_rules(taught: DataFrame, known: DataFrame, least: float, min_rows: int) -> DataFrame:
    """Rules of two classes or more, none of which holds another."""
    share = known.select("token", "class", (F.col("n_bad") / F.col("n")).alias("share"))
    exploded = taught.select("row", "bad", F.explode("tokens").alias("token")).join(broadcast_if_small(share), "token")
    ranked = exploded.groupBy("row", "bad").agg(F.array_sort(F.collect_set(F.struct((-F.col("share")).alias("order"), "class"))).alias("ranked"))
    sets = materialise(ranked.where(F.size("ranked") > 1).select("bad", F.transform("ranked", lambda x: x["class"]).alias("classes")), "url-sets")
    n, longest = sets.agg(F.count("*"), F.max(F.size("classes"))).first()
    if not n:
        return taught.sparkSession.createDataFrame([], _RULE)
    shown = F.slice("classes", 1, MOST)
    items = sets.select(F.when(F.col("bad"), F.array_append(shown, BAD)).otherwise(shown).alias("items"))
    # Half a row less, as the share times the rows is rounded up.
    model = FPGrowth(itemsCol="items", minSupport=(min_rows - 0.5) / max(min_rows, n), minConfidence=least).fit(items)
    found = model.associationRules.where((F.element_at("consequent", 1) == BAD) & (F.size("antecedent") > 1)).select(F.array_sort("antecedent").alias("antecedent"))
    often = known.select(F.col("class").alias("anchor"), "n").distinct()
    rarest = F.min_by("anchor", F.struct("n", "anchor")).alias("anchor")

    def anchored(rules: DataFrame) -> DataFrame:
        return materialise(rules.withColumn("anchor", F.explode("antecedent")).join(broadcast_if_small(often), "anchor").groupBy("antecedent").agg(rarest), "url-candidates")

    rules = anchored(found)
    if longest > MOST:
        unsure = _holding(sets.where(F.size("classes") > MOST).select("classes").distinct(), rules).select("antecedent").distinct()
        sure = rules.join(unsure, "antecedent", "left_anti").select("antecedent")
        rules = anchored(sure.unionAll(_rest(sets, known, longest, least, min_rows)))
    within = _holding(rules.select(F.col("antecedent").alias("classes")), rules).where(F.size("antecedent") < F.size("classes"))
    smallest = materialise(rules.join(within.select(F.col("classes").alias("antecedent")).distinct(), "antecedent", "left_anti"), "url-smallest")
    counted = _holding(sets, smallest, "bad").groupBy("antecedent", "anchor").agg(F.count("*").alias("n"), F.count_if("bad").alias("support"))
    sure = counted.withColumn("confidence", F.col("support") / F.col("n")).where((F.col("support") >= min_rows) & (F.col("confidence") >= least))
    return sure.select("antecedent", "confidence", "support", "anchor")


def mine_rules(tokens: DataFrame, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules (antecedent, confidence, support, anchor) over classes of tokens,
    and the classes as (token, class), from rows (tokens, bad).

    ``min_rows`` bad rows hold the antecedent, however many rows there are, and
    of all rows that hold it a share of ``min_confidence``, and ``MIN_LIFT``
    times the share of all rows, is bad.  The anchor is the rarest class (the
    smallest, on ties).  Rules that hold another rule are left out.
    """
    taught = materialise(tokens.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "url-taught")
    total = taught.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    least = max(min_confidence, MIN_LIFT * total["bad"] / max(total["n"], 1))
    known = _classes(taught, total["n"], min_rows)
    confidence = F.col("n_bad") / F.col("n")
    alone = known.where(confidence >= least).select(F.array("class").alias("antecedent"), confidence.alias("confidence"), F.col("n_bad").alias("support"), F.col("class").alias("anchor")).distinct()
    larger = _larger_rules(taught, known.where(confidence < least), least, min_rows) if least <= 1 else tokens.sparkSession.createDataFrame([], _RULE)
    rules = materialise(alone.unionByName(larger), "url-rules")
    used = rules.select(F.explode("antecedent").alias("class")).distinct()
    return rules, materialise(known.join(used, "class", "left_semi").select("token", "class"), "url-classes")


def matched(urls: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """(url, found) of the distinct (url, tokens) rows that hold a rule: the
    surest one's (by confidence, support, then text) tokens in the url, and its confidence."""
    sets = _held_classes(urls, known, "url").withColumn("classes", F.array_distinct(F.transform("pairs", lambda p: p["class"])))
    held = _holding(sets, rules, "url", "pairs")
    own = F.transform("antecedent", lambda c: F.array_min(F.filter("pairs", lambda p: p["class"] == c))["token"])
    order = F.struct("confidence", "support", F.array_join("antecedent", " "))
    return held.groupBy("url").agg(F.max_by(F.struct(own.alias("antecedent"), "confidence"), order).alias("found"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, and the mined
    rule's tokens and confidence where one was met.

    ``labels``: (doc_id, quality, toxic); the pages with these ids teach which
    tokens are bad (low quality or toxic).  A null url, or one without
    ``://``, has an empty host and path and is allowed unless mined tokens
    block it; a very long url has all its tokens; null ids and repeated rows
    stay; other columns are ignored; no rows give no rows, and no labels mine
    no rules.
    """
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    bad = labels.groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    taught = rows.join(bad, rows["page_id"] == bad["doc_id"]).select(url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), "bad")
    distinct = rows.where(F.col("url").isNotNull()).select("url", "host", "path").distinct()
    urls = distinct.select("url", url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    found = matched(urls, *mine_rules(taught))
    mined = F.when(F.col("found").isNotNull(), "block").otherwise("allow")
    return rows.join(found, "url", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"),
        F.array_join("found.antecedent", " ").alias("mined_rule"), F.col("found.confidence").alias("mined_confidence"),
    )


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
