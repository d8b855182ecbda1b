"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of domains, languages and sources. At every node it is shared among the children by
weight; a child that cannot use its share (it holds too few tokens, times the epochs allowed) is filled up and what
it leaves goes to its siblings. As a node's capacity is the sum of its leaves', a shortage reaches an ancestor's
siblings only when all nearer ones are full. A leaf serves whole epochs and then the token prefix of one more, in the
order of a digest of seed, epoch and doc_id; the last document may be cut.

A document's tokens are its words `[^\\x20\\x09-\\x0D]+`; null text has none. Null lang or source is the empty name.
Prefix sums use buckets by leading digest digits, as many as the table needs, so no leaf is sorted in one task.
Rows with a null doc_id are ordered by the digest of an empty id; equal rows are taken one by one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hot_join, setup, written

DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
LEAF = ["domain", "lang", "source"]


def weight_of(col: str, weights: dict[str, int], other: int = 1):
    out = F.lit(other)
    for k, v in weights.items():
        out = F.when(F.col(col) == k, F.lit(v)).otherwise(out)
    return out.cast("long")


def domain_of(source):
    """The synthetic tables name no domain: the last digit of the source modulo 4 stands in for it."""
    digit = F.regexp_extract(source, "([0-9])$", 1)
    return F.when(digit == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (digit.cast("int") % 4).cast("string")))


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``give``: each node's part of its parent's ``budget``, by ``weight`` and bounded by ``cap``, in whole tokens."""
    w = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = w.orderBy(F.col("cap") / F.col("weight"), name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    n = nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    n = n.withColumn("heavy", F.sum("weight").over(w) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    n = n.withColumn("full", F.col("cap") * F.col("heavy") <= F.col("left") * F.col("weight"))
    n = n.withColumn("left", F.max(F.when(~F.col("full"), F.col("left"))).over(w)).withColumn("heavy", F.max(F.when(~F.col("full"), F.col("heavy"))).over(w))
    n = n.withColumn("run", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(upto), F.lit(0)))
    part = F.expr("(left * run) div heavy - (left * (run - weight)) div heavy")
    return n.withColumn("give", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("left", "heavy", "full", "run")


def budgets(leaves: DataFrame, tenths: int, epochs: int, domain_weights: dict, language_weights: dict) -> DataFrame:
    """The leaves with ``give`` tokens each. leaves: domain, lang, source, tokens."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {tenths} div 10").alias("budget"))
    d = share_out(domains.join(F.broadcast(total)).withColumn("weight", weight_of("domain", domain_weights)), [], "domain")
    d = d.select("domain", F.col("give").alias("budget"))
    m = share_out(langs.join(d, "domain").withColumn("weight", weight_of("lang", language_weights)), ["domain"], "lang")
    m = m.select("domain", "lang", F.col("give").alias("budget"))
    return share_out(leaves.join(m, ["domain", "lang"]).withColumn("weight", F.lit(1).cast("long")), ["domain", "lang"], "source")


def mix(docs: DataFrame, tenths: int = 4, epochs: int = 3, seed: int = 17, per_bucket: int = 2000, domain=None, domain_weights: dict = DOMAIN_WEIGHTS, language_weights: dict = LANGUAGE_WEIGHTS, also: list[str] = []) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epochs_full, tokens_prefix, tokens_taken of every document.

    tenths: budget in tenths of all tokens; epochs: how often a leaf may be served; domain: a column of docs;
    also: columns of docs that are handed through.
    """
    setup(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (domain if domain is not None else domain_of(name("source"))).alias("domain"), name("lang").alias("lang"), name("source").alias("source"), words.alias("n_tokens"), *also)
    rows = written(rows, "mix")
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    plan = written(budgets(leaves, tenths, epochs, domain_weights, language_weights), "budget")
    plan = plan.select(*LEAF, "n", F.expr("if(tokens = 0, 0, give div tokens)").alias("epochs_full"), F.expr("if(tokens = 0, 0, give % tokens)").alias("rest"))
    digits, total = 1, rows.count()
    while 16**digits * per_bucket < total and digits < 12:
        digits += 1
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs_full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = hot_join(rows, plan, LEAF, F.col("n")).drop("n").withColumn("key", key).withColumn("bucket", F.substring("key", 1, digits))
    sums = rows.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("held"))
    sums = sums.withColumn("base", F.coalesce(F.sum("held").over(W.partitionBy(*LEAF).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("held")
    inside = W.partitionBy(*LEAF, "bucket").orderBy("key", "doc_id", "n_tokens", *also).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums, [*LEAF, "bucket"])
    prefix = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("base") - F.col("before")))
    return rows.select("doc_id", *LEAF, "n_tokens", "epochs_full", prefix.alias("tokens_prefix"), (F.col("epochs_full") * F.col("n_tokens") + prefix).alias("tokens_taken"), *also)


def _sql_level(nodes: str, parent: str, name: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""SELECT *, CASE WHEN full_ THEN cap ELSE (lf * run) // hv - (lf * (run - weight)) // hv END AS give FROM (
  SELECT * EXCLUDE (lf, hv), max(CASE WHEN NOT full_ THEN lf END) OVER ({part}) AS lf, max(CASE WHEN NOT full_ THEN hv END) OVER ({part}) AS hv,
    coalesce(sum(CASE WHEN NOT full_ THEN weight END) OVER ({part} ORDER BY cap / weight, {name} ROWS UNBOUNDED PRECEDING), 0) AS run FROM (
  SELECT *, cap * hv <= lf * weight AS full_ FROM (
  SELECT *, budget - coalesce(sum(cap) OVER ({part} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lf,
    sum(weight) OVER ({part}) - coalesce(sum(weight) OVER ({part} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hv
  FROM ({nodes}))))"""


_CASE = {k: f"CASE {k} " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in w.items()) + " ELSE 1 END" for k, w in (("domain", DOMAIN_WEIGHTS), ("lang", LANGUAGE_WEIGHTS))}
SQL = f"""
WITH r0 AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract(coalesce(source, ''), '([0-9])$', 1) AS dg,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
r AS (SELECT doc_id, CASE WHEN dg = '' THEN 'other' ELSE 'd' || (dg::INT % 4) END AS domain, lang, source, n_tokens FROM r0),
lv AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * 3 AS cap FROM r GROUP BY ALL),
dm AS ({_sql_level(f"SELECT domain, sum(cap) AS cap, any_value(b) AS budget, {_CASE['domain']} AS weight FROM lv, (SELECT sum(tokens) * 4 // 10 AS b FROM lv) GROUP BY domain", "", "domain")}),
lg AS ({_sql_level(f"SELECT lv.domain, lv.lang, sum(lv.cap) AS cap, any_value(dm.give) AS budget, {_CASE['lang'].replace('CASE lang', 'CASE lv.lang')} AS weight FROM lv JOIN dm ON lv.domain = dm.domain GROUP BY ALL", "domain", "lang")}),
sc AS ({_sql_level("SELECT lv.domain, lv.lang, lv.source, lv.tokens, lv.cap, lg.give AS budget, 1 AS weight FROM lv JOIN lg ON lv.domain = lg.domain AND lv.lang = lg.lang", "domain, lang", "source")}),
j AS (SELECT r.*, CASE WHEN tokens = 0 THEN 0 ELSE give // tokens END AS epochs_full, CASE WHEN tokens = 0 THEN 0 ELSE give % tokens END AS rest
  FROM r JOIN sc ON r.domain = sc.domain AND r.lang = sc.lang AND r.source = sc.source),
k AS (SELECT *, md5('17:' || epochs_full::BIGINT || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM j),
s AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM k)
SELECT doc_id, domain, lang, source, n_tokens, epochs_full::BIGINT AS epochs_full, greatest(0, least(n_tokens, rest - st))::BIGINT AS tokens_prefix,
  (epochs_full * n_tokens + greatest(0, least(n_tokens, rest - st)))::BIGINT AS tokens_taken FROM s
"""


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
