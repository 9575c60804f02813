"""Mixing sources to target weights, in DataFrame operations only.

Weights are propagated through a tree of domains, languages and sources. Every
node shares its token budget among its children by weight, but a child gets no
more than its documents can supply in the epochs allowed; what it can't use goes
to its siblings first, and only what a whole family can't use goes to its
parent's siblings. Each leaf then takes its token prefix: whole epochs, and of
one more epoch, in an order seeded for that epoch, the documents up to the budget.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ordered_prefix

LEVELS = ("domain", "lang", "source")
TOKEN = r"[^\x09-\x0D\x20]+"
MAX_WEIGHT = 1000
_NONE = "(none)"
SALT = 16  # tasks over which the rows of a leaf are joined


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    named = weights.get(level, {})
    for value, w in named.items():
        if not 0 <= w <= MAX_WEIGHT or w != int(w):
            raise ValueError(f"weight of {level} {value!r} must be an integer from 0 to {MAX_WEIGHT}")
    if not named:
        return F.lit(1).cast("long")
    # one constant, however many values are named
    known = F.from_json(F.lit(json.dumps({v: int(w) for v, w in named.items()})), "map<string,bigint>")
    return F.coalesce(F.try_element_at(known, F.col(level)), F.lit(1).cast("long"))


def _share_out(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """``budget`` of each child from its parent's ``_given``, by ``_w`` and ``_cap``.

    Children in order of cap for weight; those that their fair share of what is
    left would fill are filled, the others share the rest by weight, in whole
    tokens, the odd ones by name.
    """
    order = [F.col("_cap") / F.col("_w"), F.col(level)]
    fam = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    upto = fam.orderBy(*order)
    n = nodes.withColumn("_before", F.sum("_cap").over(upto.rowsBetween(Window.unboundedPreceding, -1)))
    n = n.withColumn("_before", F.coalesce("_before", F.lit(0)).cast("long"))
    n = n.withColumn("_left_w", F.sum("_w").over(upto.rowsBetween(0, Window.unboundedFollowing)))
    n = n.withColumn("_full", F.col("_cap") * F.col("_left_w") <= (F.col("_given") - F.col("_before")) * F.col("_w"))
    n = n.withColumn("_rest", F.col("_given") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(fam))
    n = n.withColumn("_open_w", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(fam))
    n = n.withColumn("_share", F.when(F.col("_full"), F.col("_cap")).otherwise(F.expr("(_rest * _w) div _open_w")))
    n = n.withColumn("_odd", F.col("_rest") - F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_share"))).over(fam))
    n = n.withColumn("_nth", F.sum(F.when(F.col("_full"), 0).otherwise(1)).over(fam.orderBy(level).rowsBetween(Window.unboundedPreceding, 0)))
    extra = F.when(~F.col("_full") & (F.col("_nth") <= F.col("_odd")), 1).otherwise(0)
    return n.withColumn("budget", (F.col("_share") + extra).cast("long"))


def budgets(leaves: DataFrame, budget: Column, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """``leaves`` (LEVELS, tokens) with the tokens that each shall give, ``budget``.

    ``budget`` is a constant or an aggregate over the leaves. Values that
    ``weights`` doesn't name weigh 1; weight 0 takes a branch out.
    """
    w = leaves.withColumns({f"_w_{v}": _weight(v, weights) for v in LEVELS})
    for v in LEVELS:
        w = w.where(F.col(f"_w_{v}") > 0)
    w = w.withColumn("_cap", F.col("tokens") * max_epochs)
    given = None
    for k, level in enumerate(LEVELS):
        path, parent = list(LEVELS[: k + 1]), list(LEVELS[:k])
        nodes = w.groupBy(*path).agg(F.sum("_cap").alias("_cap"), F.first(f"_w_{level}").alias("_w"))
        if given is None:
            asked = leaves.agg(budget.cast("long").alias("_asked"))  # one row, as the sum below
            root = nodes.agg(F.sum("_cap").alias("_all")).crossJoin(asked)
            nodes = nodes.crossJoin(F.broadcast(root.select(F.least("_asked", "_all").alias("_given"))))
        else:
            nodes = nodes.join(given.withColumnRenamed("budget", "_given"), parent)
        given = _share_out(nodes, parent, level).select(*path, "budget")
    return leaves.join(given, list(LEVELS)).select(*LEVELS, "tokens", "budget")


def _per_leaf(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """``rows`` with the columns of their leaf. A leaf may hold a third of all rows:
    its row is copied SALT times, so that its rows are joined in as many tasks."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id", "n_tokens"), F.lit(SALT)).cast("int"))
    copies = leaves.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(copies, [*LEVELS, "_salt"]).drop("_salt")


def mix(docs: DataFrame, domain: Column, budget_share: float = 1.0, weights: dict[str, dict[str, int]] | None = None,
        max_epochs: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        source_col: str = "source") -> DataFrame:
    """(id, domain, lang, source, epoch, n_tokens, take): the documents chosen.

    The budget is ``budget_share`` of the tokens of all documents; tokens are
    words between ASCII white space. A row for each epoch that a document is
    taken in; ``take`` is less than ``n_tokens`` only where a leaf's prefix ends
    inside the document. Null and empty texts, and texts of white space, have no
    tokens and are never chosen. A null domain, language or source counts as
    "(none)". A null id is ordered as an empty one; repeated rows are rows of
    their own. Ties in the order go to the shorter text. An empty table gives an
    empty one.
    """
    if max_epochs < 1 or budget_share < 0:
        raise ValueError("need max_epochs >= 1 and budget_share >= 0")
    weights = weights or {}
    name = lambda c: F.coalesce(c.cast("string"), F.lit(_NONE))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), name(domain).alias("domain"), name(F.col(lang_col)).alias("lang"),
                       name(F.col(source_col)).alias("source"),
                       F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_tokens"))
    rows = cut(rows.where("n_tokens > 0"), "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = cut(budgets(leaves, F.floor(F.sum("tokens") * F.lit(budget_share)), weights, max_epochs), "mix-budgets")
    plan = plan.select(*LEVELS, F.expr("budget div tokens").alias("_whole"), (F.col("budget") % F.col("tokens")).alias("_rest"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    keyed = _per_leaf(rows, plan).withColumn("_key", key)
    placed = ordered_prefix(keyed, [*LEVELS, "_key", "id", "n_tokens"], {"_at": "n_tokens"}, "mix-order")
    first = placed.groupBy(*LEVELS).agg(F.min("_at").alias("_base"))
    placed = _per_leaf(placed, first).withColumn("_at", F.col("_at") - F.col("_base"))
    last = F.when(F.col("_at") < F.col("_rest"), F.col("_whole")).otherwise(F.col("_whole") - 1)
    chosen = placed.withColumn("_last", last).where("_last >= 0")
    chosen = chosen.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    take = F.when(F.col("epoch") < F.col("_whole"), F.col("n_tokens")).otherwise(F.least("n_tokens", F.col("_rest") - F.col("_at")))
    return chosen.select("id", *LEVELS, F.col("epoch").cast("int").alias("epoch"), "n_tokens", take.alias("take"))
