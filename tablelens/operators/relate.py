"""Correlation, covariance and categorical association.

Matrices are long ``(a, b, value)`` tables. All numeric pairs are expressions
of a single aggregate; Spearman ranks come from the skew-safe cumulative
helper; Cramer's V builds every column pair's contingency table in one
group-by over exploded (pair, value_a, value_b) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import col

from tablelens.functions.stats import materialize, ranked_values, rnd, safe_corr
from tablelens.operators.groups import label


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i:]]


def _numbers(df: DataFrame, cols) -> DataFrame:
    """The columns as doubles, null where they hold no number."""
    return df.select(*[F.when(~F.isnan(col(c).try_cast("double")), col(c).try_cast("double")).alias(c)
                       for c in cols])


def _matrix(df: DataFrame, cols, fn, digits=4, sides=None) -> DataFrame:
    """``sides`` names the two columns of ``df`` that stand for a pair, where they are not the pair's own."""
    pairs = _pairs(list(cols))
    sides = [(sides or {}).get(p, p) for p in pairs]
    sub = _numbers(df, list(dict.fromkeys(c for side in sides for c in side)))
    one = sub.agg(*[fn(col(x), col(y)).alias(f"p{i}") for i, (x, y) in enumerate(sides)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("v")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"p{i}").alias("v")))
    value = F.col("c.v") if digits is None else rnd("c.v", digits)
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.a", "c.b", value.alias("value"))


def correlation_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson",
                       digits: int | None = 4) -> DataFrame:
    """Long (a, b, value) incl. the diagonal; pairwise-complete rows;
    null where a side is constant; ``digits=None`` leaves the values unrounded."""
    cols = list(cols)
    if method == "spearman":
        num, ranked, sides = complete_sides(df, cols)
        return _matrix(_ranks(num, ranked), cols, safe_corr, digits, sides)
    return _matrix(df, cols, safe_corr, digits)


def complete_sides(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict, dict]:
    """The columns as numbers, what a rank correlation ranks of them, and the two ranks that stand for each pair.

    A column is ranked once for all partners without gaps. Beside a partner that has nulls, it is ranked over
    the rows where the partner has a value, as a column of its own: at most two more per pair with a gap."""
    num = _numbers(df, cols)
    gaps = num.agg(*[F.count_if(col(c).isNull()).alias(c) for c in cols]).first().asDict()
    ranked, sides = {c: (c, None) for c in cols}, {}

    def beside(c, partner):
        if c == partner or not gaps[partner]:
            return c
        name = f"{c} | {partner}"
        ranked[name] = (c, partner)
        return name

    for a, b in _pairs(list(cols)):
        sides[a, b] = beside(a, b), beside(b, a)
    return num, ranked, sides


def covariance_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample covariance (n-1) for every pair, incl. variances."""
    def cov(x, y):
        return F.covar_samp(F.when(y.isNotNull(), x), F.when(x.isNotNull(), y))
    return _matrix(df, cols, cov)


def rank_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Average ranks (ties share the mean rank) of each column, one row per input row."""
    return _ranks(_numbers(df, cols), {c: (c, None) for c in cols})


# Distinct values up to this number are sent to the tasks; of larger columns, only values in more than HOT rows.
MAX_SENT_VALUES, HOT = 200_000, 50_000


def _ranks(num: DataFrame, ranked: dict) -> DataFrame:
    """Average ranks under the names in ``ranked``: name -> (column of ``num``, partner or None: the column is ranked over the
    rows where the partner has a value).

    Ranks come from the distinct-value table of each column (counted once for all its partners, range-partitioned
    cumulative counts) and are joined to the rows column by column. A column with few distinct values is joined without a shuffle; of one with many, the rows are
    shuffled once on its value, but those with a value that many rows hold are joined without a shuffle, so no task gets them all."""
    sources = list(dict.fromkeys(c for c, _ in ranked.values()))
    partners = list(dict.fromkeys(p for _, p in ranked.values() if p is not None))
    # one row per (row, column) only inside the map side of this count
    flags = [col(p).isNotNull().alias(f"_p{i}") for i, p in enumerate(partners)]
    long = num.select(*[col(c) for c in sources], *flags).unpivot([f"_p{i}" for i in range(len(partners))], [col(c) for c in sources], "column", "value")
    counts = materialize(long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("cnt"), *[F.count_if(F.col(f"_p{i}")).alias(f"_p{i}") for i in range(len(partners))]))
    of = {None: "cnt"} | {p: f"_p{i}" for i, p in enumerate(partners)}
    wanted = [F.struct(F.lit(name).alias("name"), F.lit(c).alias("column"), F.col(of[p]).alias("cnt")) for name, (c, p) in ranked.items()]
    each = counts.select(F.col("column").alias("_c"), "value", F.explode(F.array(*wanted)).alias("w")) \
        .where((F.col("_c") == F.col("w.column")) & (F.col("w.cnt") > 0)).select("w.name", "value", "w.cnt")
    found = materialize(ranked_values(each, ["name"], "value").select("name", "value", (F.col("_start") + (F.col("cnt") + 1) / 2.0).alias("rank")))
    distinct = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    out, place = num, {n: i for i, n in enumerate(ranked)}
    for c in sorted(sources, key=lambda c: -distinct.get(c, 0)):  # shuffled ones first, while the rows are short
        names = [n for n, (source, _) in ranked.items() if source == c]
        table = found.where(F.col("name").isin(*names)).groupBy("value").agg(
            *[F.max(F.when(F.col("name") == n, F.col("rank"))).alias(f"_r{place[n]}") for n in names])
        out = _with_ranks(out, c, counts, table, distinct.get(c, 0))
    return out.select(*[(F.col(f"_r{i}") if p is None else F.when(col(p).isNotNull(), F.col(f"_r{i}"))).alias(n)
                        for i, (n, (_, p)) in enumerate(ranked.items())])


def _with_ranks(rows: DataFrame, c: str, counts: DataFrame, table: DataFrame, distinct: int) -> DataFrame:
    """``rows`` with the rank columns of ``table`` (value, ranks) by the value of column ``c``; null beside a null."""
    table = table.withColumnRenamed("value", "_v")
    new = [n for n in table.columns if n != "_v"]
    if distinct <= MAX_SENT_VALUES:
        return rows.join(F.broadcast(table), col(c) == F.col("_v"), "left").drop("_v")
    hot = materialize(counts.where((F.col("column") == c) & (F.col("cnt") > HOT)).select(F.col("value").alias("_v")))  # at most rows / HOT values
    few = F.broadcast(table.join(F.broadcast(hot), "_v"))
    sent = rows.join(few.select("_v", F.lit(True).alias("_hot"), *[F.col(n).alias(f"{n}h") for n in new]), col(c) == F.col("_v"), "left").drop("_v")
    # rows that have their ranks, or need none, are dealt by their number and meet no value
    apart = F.col("_hot").isNotNull() | col(c).isNull()
    dealt = sent.withColumn("_deal", F.when(apart, 1 + F.pmod(F.monotonically_increasing_id(), F.lit(1_000_003))).otherwise(F.lit(0).cast("long")))
    met = dealt.join(table.withColumn("_zero", F.lit(0).cast("long")), (F.col("_deal") == F.col("_zero")) & (col(c) == F.col("_v")), "left")
    return met.select(*[col(n) for n in rows.columns], *[F.coalesce(f"{n}h", n).alias(n) for n in new])


def strongest_pairs(matrix: DataFrame, cols: Sequence[str], top_n: int = 10) -> DataFrame:
    """Upper-triangle pairs by |value| desc: (a, b, corr, strength, rank). Ranks follow the values given
    (an unrounded matrix: ``digits=None``); the output is rounded."""
    order = {c: i for i, c in enumerate(cols)}
    pos = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    up = matrix.filter((pos[F.col("a")] < pos[F.col("b")]) & F.col("value").isNotNull() & ~F.isnan("value"))
    top = up.orderBy(F.abs("value").desc(), pos[F.col("a")], pos[F.col("b")]).limit(top_n)
    from pyspark.sql import Window
    w = Window.orderBy(F.abs("value").desc(), pos[F.col("a")], pos[F.col("b")])  # <= top_n rows
    return top.select("a", "b", rnd("value").alias("corr"), rnd(F.abs("value")).alias("strength"),
                      F.row_number().over(w).cast("long").alias("rank"))


def categorical_associations(df: DataFrame, cols: Sequence[str], top_n: int | None = 10) -> DataFrame:
    """Cramer's V for every pair of categorical columns (null is its own
    category): (a, b, cramers_v, chi2, n, rank). chi2 = n*(sum o^2/(r_i c_j) - 1)."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), label(a).alias("va"), label(b).alias("vb"))
                    for a, b in pairs])
    cells = (df.select(F.explode(arr).alias("p")).select("p.*")
               .groupBy("a", "b", "va", "vb").agg(F.count(F.lit(1)).alias("o")))
    rows = cells.groupBy("a", "b", "va").agg(F.sum("o").alias("ri"))
    cols_ = cells.groupBy("a", "b", "vb").agg(F.sum("o").alias("cj"))
    t = cells.join(rows, ["a", "b", "va"]).join(cols_, ["a", "b", "vb"])
    s = t.groupBy("a", "b").agg(
        F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("ri") * F.col("cj"))).alias("_s"),
        F.count_distinct("va").alias("r"), F.count_distinct("vb").alias("c"))
    chi2 = F.col("n") * (F.col("_s") - 1)
    k = F.least("r", "c")
    v = F.when((F.col("n") == 0) | (k < 2) | (chi2 <= 0), F.lit(0.0)).otherwise(
        F.sqrt(chi2 / (F.col("n") * (k - 1))))
    res = s.select("a", "b", rnd(v).alias("cramers_v"), rnd(chi2).alias("chi2"), F.col("n").cast("long"))
    order = {c: i for i, c in enumerate(cols)}
    pos = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    from pyspark.sql import Window
    w = Window.orderBy(F.col("cramers_v").desc(), pos[F.col("a")], pos[F.col("b")])  # one row per pair
    res = res.withColumn("rank", F.row_number().over(w).cast("long"))
    return res if top_n is None else res.filter(F.col("rank") <= top_n)


def relationship_report(df: DataFrame, types: dict) -> dict:
    """pearson/spearman/covariance when >=2 numeric, associations when >=2
    categorical."""
    from tablelens.functions.types import categorical_cols, numeric_cols
    num, cat = numeric_cols(types), categorical_cols(types)
    out = {}
    if len(num) >= 2:
        out["pearson"] = correlation_matrix(df, num)
        out["spearman"] = correlation_matrix(df, num, "spearman")
        out["covariance"] = covariance_matrix(df, num)
        out["strongest"] = strongest_pairs(correlation_matrix(df, num, digits=None), num)
    if len(cat) >= 2:
        out["categorical"] = categorical_associations(df, cat)
    return out

