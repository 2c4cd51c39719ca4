"""Mixing sources to target weights down a tree of domains, languages and sources.

DataFrame functions only. Budgets go from the root down: the children of a node share its budget by
weight; a child that has fewer tokens than its share gives the rest back to its siblings, and only when all
of them are used up does a shortage reach the level above (a node's capacity is the sum of its leaves').
A leaf then takes whole passes over its documents while its budget allows, and of the next pass
a prefix of its tokens in an order seeded by the pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
SPREAD = 1024  # parts of a leaf's order that are summed before it is ranked, so that no leaf is ranked in one task


def weight(weights: dict[tuple[str, ...], int], path: list[str]) -> Column:
    """The weight of the node at the columns ``path``: its entry in ``weights``, else 1."""
    own = {"\x1f".join(k): v for k, v in weights.items() if len(k) == len(path)}
    if not own:
        return F.lit(1).cast("long")
    entries = F.create_map(*[F.lit(x) for kv in own.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, F.concat_ws("\x1f", *path)), F.lit(1)).cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split ``budget`` of each parent among its rows by ``weight`` up to ``capacity``, in whole tokens.

    Children ordered by capacity over weight: one is used up when its capacity is at most its share of
    what those before it left over. The others share the remainder by weight, rounded cumulatively."""
    by = Window.partitionBy(*parent, "budget")
    order = by.orderBy(F.col("capacity") / F.col("weight"), name)
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("budget") - F.sum("capacity").over(until) + F.col("capacity")
    fits = F.col("capacity") * F.sum("weight").over(behind) <= left * F.col("weight")
    used = nodes.withColumn("fits", fits.cast("int")).withColumn("used_up", F.min("fits").over(until) == 1)
    rest = F.col("budget") - F.sum(F.when(F.col("used_up"), F.col("capacity")).otherwise(0)).over(by)
    free = F.when(F.col("used_up"), 0).otherwise(F.col("weight"))
    shared = (used.withColumn("rest", rest).withColumn("free", F.sum(free).over(by))
              .withColumn("upto", F.sum(free).over(until)))
    part = F.expr("(rest * upto) div free - (rest * (upto - weight)) div free")
    return shared.withColumn("budget", F.when(F.col("used_up"), F.col("capacity")).otherwise(part)) \
        .drop("fits", "used_up", "rest", "free", "upto")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[tuple[str, ...], int],
                 share: tuple[int, int], passes: int) -> DataFrame:
    """(levels, available, budget): the root's budget is ``share`` of all tokens."""
    nodes = leaves.withColumn("capacity", F.col("available") * passes)
    for depth in range(1, len(levels) + 1):  # a node of weight 0 takes no part
        nodes = nodes.where(weight(weights, levels[:depth]) > 0)
    asked = leaves.agg((F.sum("available") * share[0]).alias("asked"))
    root = nodes.agg(F.sum("capacity").alias("most")).crossJoin(F.broadcast(asked)) \
        .select(F.expr(f"least(most, asked div {share[1]})").alias("budget"))  # one row and one row
    above = None
    for depth, name in enumerate(levels, 1):
        path = levels[:depth]
        level = nodes.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("available").alias("available")) \
            .withColumn("weight", weight(weights, path))
        level = level.crossJoin(F.broadcast(root)) if above is None else level.join(above, path[:-1])
        above = share_out(level, path[:-1], name).select(*path, "budget", *(["available"] if depth == len(levels) else []))
    return above


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[tuple[str, ...], int], share: tuple[int, int] = (1, 1),
        passes: int = 4, seed: str = "0", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, levels, tokens, copies, tokens_taken, budget) of every document that is taken.

    ``levels`` are the tree's columns from the root down, over the input's columns; their nulls count as
    "unknown". Tokens are runs of other than ASCII white space. ``copies`` counts the passes that hold the
    document, ``tokens_taken`` its tokens in them (the last document of a leaf's last pass may be cut).
    Null and empty texts have no tokens and are not taken; a null id ranks as the empty id;
    rows that repeat a doc_id are taken each; an empty table gives no rows.
    """
    names = list(levels)
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                          *[F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for n, c in levels.items()],
                          F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))
    counted = stored(counted.where("tokens > 0"), "counted")
    leaves = stored(leaf_budgets(counted.groupBy(*names).agg(F.sum("tokens").alias("available")),
                                 names, weights, share, passes), "leaves")
    whole, rest = F.expr("budget div available"), F.expr("budget % available")
    order = F.md5(F.concat_ws(":", F.lit(seed), "whole", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    keyed = (counted.join(leaves.select(*names, "budget", whole.alias("whole"), rest.alias("rest")), names)
             .withColumn("at", order)
             .withColumn("part", F.conv(F.substring("at", 1, 4), 16, 10).cast("int") % SPREAD))
    sums = keyed.groupBy(*names, "part").agg(F.sum("tokens").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(
        Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    within = Window.partitionBy(*names, "part").orderBy("at", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (keyed.join(before, [*names, "part"])
              .withColumn("before", F.coalesce("before", F.lit(0)) + F.sum("tokens").over(within) - F.col("tokens"))
              .withColumn("cut", F.greatest(F.lit(0), F.least("tokens", F.col("rest") - F.col("before")))))
    return ranked.withColumn("copies", F.col("whole") + F.when(F.col("cut") > 0, 1).otherwise(0)).where("copies > 0") \
        .select("doc_id", *names, "tokens", F.col("copies").cast("long").alias("copies"),
                (F.col("whole") * F.col("tokens") + F.col("cut")).cast("long").alias("tokens_taken"), "budget")
