"""Mixing sources to target weights along a domain-language-source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SEPARATORS, keep, send_if_small, text_of

LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of the order key by which a leaf is split: 4096 buckets a leaf.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, SEPARATORS), "")).cast("long")


def source_family(families: int = 4) -> Column:
    """Domain of the test tables, which have none: sources dealt into families by their names."""
    return F.concat(F.lit("family"), F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit(""))), F.lit(families)).cast("string"))


def measured(docs: DataFrame, domain: Column) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens; null names are ''."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("_text"), name(domain).alias("domain"), name(docs["lang"]).alias("lang"), name(docs["source"]).alias("source"))
    return rows.select("doc_id", *LEVELS, word_count(F.col("_text")).alias("n_tokens"))


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share out each parent's ``budget`` among its nodes by ``weight``, none above its ``cap``.

    What capped nodes leave goes to their siblings by weight. With nodes in order of cap / weight the common
    level is the largest of (budget - caps before) / (weight - weights before).
    """
    per = Window.partitionBy(*parent)
    before = per.orderBy(F.col("cap") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(per) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = nodes.withColumn("_level", level).withColumn("_level", F.max("_level").over(per))
    return leveled.withColumn("budget", F.least("cap", F.col("_level") * F.col("weight"))).drop("_level")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], temperature: float, budget: float | None, max_epochs: float) -> DataFrame:
    """Budget, whole epochs and rest of every leaf (domain, lang, source, tokens).

    A node weighs what ``weights[level][name]`` says, else its tokens to the power ``temperature``; weights are shares
    among siblings. Budgets go down the tree; a node without enough tokens (``max_epochs`` times what it has) leaves its shortage to its
    siblings, and only what a whole family can't fill goes to the family's siblings. No ``budget``: the least
    at which each leaf gets at least one epoch.
    """

    def weigh(nodes: DataFrame, level: str) -> DataFrame:
        given = weights.get(level) or {}
        weight = F.pow(F.col("tokens").cast("double"), F.lit(temperature))
        if given:
            known = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))])
            weight = F.coalesce(F.try_element_at(known, F.col(level)), weight)
        return nodes.withColumn("weight", F.greatest(weight, F.lit(1e-9))).withColumn("cap", F.col("tokens") * float(max_epochs))

    total = lambda keys: leaves.groupBy(*keys).agg(F.sum("tokens").alias("tokens"))
    domains, langs, sources = (weigh(total(LEVELS[: k + 1]), level) for k, level in enumerate(LEVELS))
    domains = domains.withColumn("_root", F.lit(0))
    share = lambda df, parent, c: df.select(*[x for x in LEVELS if x in df.columns], (F.col("weight") / F.sum("weight").over(Window.partitionBy(*parent))).alias(c))
    shares = share(sources, LEVELS[:2], "s3").join(share(langs, LEVELS[:1], "s2"), list(LEVELS[:2])).join(share(domains, ["_root"], "s1"), "domain")
    shares = shares.select(*LEVELS, (F.col("s1") * F.col("s2") * F.col("s3")).alias("weight"))
    if budget is None:
        budget = shares.join(leaves, list(LEVELS)).agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
        budget *= 1 + 1e-9
    first = fill(domains.withColumn("budget", F.lit(float(budget))), ["_root"], "domain").select("domain", "budget")
    second = fill(langs.join(first, "domain"), ["domain"], "lang").select("domain", "lang", "budget")
    third = fill(sources.join(second, ["domain", "lang"]), ["domain", "lang"], "source")
    out = third.select(*LEVELS, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget")).join(shares, list(LEVELS))
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    return out.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def order_key(seed: int) -> Column:
    """Place of a document in the leaf's last epoch: every epoch has an order of its own."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def choose(measures: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """Every document with ``copies`` and ``take_tokens``: whole epochs, and a prefix of one more.

    Prefix sums run within 4096 buckets of the order key a leaf, on top of sums of whole buckets, so that the largest leaf is spread over tasks.
    """
    keyed = measures.join(send_if_small(leaves), list(LEVELS)).withColumn("key", order_key(seed)).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    per = [*LEVELS, "bucket"]
    sums = keyed.groupBy(*per).agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*per, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy(*per).orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_in", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(bases, per).withColumn("before", F.col("base") + F.col("_in"))
    part = F.greatest(F.least(F.col("n_tokens"), F.col("rest") - F.col("before")), F.lit(0))
    placed = placed.withColumn("in_rest", (F.col("rest") > 0) & (F.col("before") < F.col("rest")))
    return placed.select("doc_id", *LEVELS, "n_tokens", "weight", "budget", "epochs", (F.col("epochs") + F.col("in_rest").cast("long")).alias("copies"), (F.col("epochs") * F.col("n_tokens") + part).alias("take_tokens"), "in_rest", "key")


def mixture(docs: DataFrame, domain: Column, weights: dict | None = None, temperature: float = 0.7, budget: float | None = None, budget_share: float | None = None, max_epochs: float = 4.0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(leaves, documents) of a mixture; see :func:`leaf_budgets` and :func:`choose`.

    ``budget``: tokens (words) to draw, or ``budget_share`` times all there are. Null lang, source or domain: a node
    named ''. Null or empty text: no tokens. Null or repeated ids: a row each. An empty table gives no rows. Columns that are not
    named here are ignored.
    """
    measures = keep(measured(docs, domain), "mix-measures")
    leaves = measures.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    if budget_share is not None:
        budget = budget_share * (measures.agg(F.sum("n_tokens")).first()[0] or 0)
    budgets = keep(leaf_budgets(leaves, weights or {}, temperature, budget, max_epochs), "mix-leaves")
    return budgets, choose(measures, budgets, seed)


def mixed_documents(docs: DataFrame, domain: Column, seed: int = 1, **how) -> DataFrame:
    """The documents of a mixture, each as often as it is drawn, with their own columns.

    The documents of a leaf's last epoch are those up to one order key, so only a row per leaf meets the texts.

    Null lang, source or domain: a node named ''. Null, empty or wordless text: no tokens; such a document is drawn with the epochs of its
    leaf. Null ids and repeated rows are drawn like others; rows of one leaf with equal ids have one order key and are drawn alike.
    Very long texts count whole. An empty table gives no rows. Columns of any name are carried and clash with nothing.
    """
    budgets, chosen = mixture(docs, domain, seed=seed, **how)
    cuts = chosen.filter("in_rest").groupBy(*LEVELS).agg(F.max("key").alias("cut"))
    leaves = send_if_small(keep(budgets.join(cuts, list(LEVELS), "left").select(*LEVELS, "epochs", "cut"), "mix-cuts"))
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    # a row's own columns travel as one
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    keyed = docs.select(row, docs["doc_id"].cast("long").alias("doc_id"), name(domain).alias("domain"), name(docs["lang"]).alias("lang"), name(docs["source"]).alias("source")).join(leaves, list(LEVELS))
    copies = F.col("epochs") + F.coalesce(order_key(seed) <= F.col("cut"), F.lit(False)).cast("long")
    drawn = keyed.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return drawn.select("row.*")


def op2_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _, chosen = mixture(docs, source_family(), {"lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}}, temperature=0.7, budget_share=1.0, max_epochs=4.0, seed=1)
    return chosen.select("doc_id", *LEVELS, "n_tokens", "budget", "epochs", "copies", "take_tokens")


_FILL = """SELECT * EXCLUDE (lv), least(cap, max(lv) OVER (PARTITION BY {p}) * weight) AS budget FROM (
  SELECT *, (pbudget - coalesce(sum(cap) OVER (PARTITION BY {p} ORDER BY cap / weight, {n} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER (PARTITION BY {p}) - coalesce(sum(weight) OVER (PARTITION BY {p} ORDER BY cap / weight, {n} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv FROM {t})"""

ORACLE = f"""
WITH crc(t) AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))),
fam AS (SELECT source, 'family' || CAST(xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(source, ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 4 AS VARCHAR) AS domain
  FROM (SELECT DISTINCT source FROM documents), crc),
m AS (SELECT d.doc_id, f.domain, d.lang, d.source, len(list_filter(regexp_split_to_array(coalesce(d.text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents d JOIN fam f USING (source)),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM m GROUP BY ALL),
d1 AS (SELECT domain, sum(tokens) AS tokens, greatest(pow(sum(tokens)::DOUBLE, 0.7), 1e-9) AS weight, sum(tokens) * 4.0::DOUBLE AS cap, 0 AS root, (SELECT sum(tokens) FROM leaves)::DOUBLE AS pbudget FROM leaves GROUP BY domain),
a1 AS ({_FILL.format(p="root", n="domain", t="d1")}),
d2 AS (SELECT l.domain, l.lang, CASE l.lang WHEN 'en' THEN 0.5::DOUBLE WHEN 'de' THEN 0.2::DOUBLE WHEN 'fr' THEN 0.2::DOUBLE WHEN 'es' THEN 0.1::DOUBLE ELSE greatest(pow(sum(tokens)::DOUBLE, 0.7), 1e-9) END AS weight, sum(tokens) * 4.0::DOUBLE AS cap, any_value(pb) AS pbudget
  FROM leaves l JOIN (SELECT domain, budget AS pb FROM a1) a USING (domain) GROUP BY l.domain, l.lang),
a2 AS ({_FILL.format(p="domain", n="lang", t="d2")}),
d3 AS (SELECT l.domain, l.lang, l.source, tokens, greatest(pow(tokens::DOUBLE, 0.7), 1e-9) AS weight, tokens * 4.0::DOUBLE AS cap, pb AS pbudget FROM leaves l JOIN (SELECT domain, lang, budget AS pb FROM a2) a USING (domain, lang)),
a3 AS ({_FILL.format(p="domain, lang", n="source", t="d3")}),
b AS (SELECT domain, lang, source, tokens, floor(budget + 1e-6)::BIGINT AS budget FROM a3),
e AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM b),
k AS (SELECT m.*, e.budget, e.epochs, e.budget - e.epochs * e.tokens AS rest, md5('1:' || CAST(e.epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS key FROM m JOIN e USING (domain, lang, source)),
p AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM k)
SELECT doc_id, domain, lang, source, n_tokens, budget, epochs::BIGINT AS epochs, (epochs + (rest > 0 AND before < rest)::INT)::BIGINT AS copies, (epochs * n_tokens + greatest(least(n_tokens, rest - before), 0))::BIGINT AS take_tokens FROM p
"""
