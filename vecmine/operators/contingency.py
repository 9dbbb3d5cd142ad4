"""Statistics of a contingency table given in long form: (row_key, col_key, n), zero cells left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi_square_tail, log_gamma
from ..session import cut_lineage, settle_small


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    return df.groupBy(F.col(row).alias("row_key"), F.col(col).alias("col_key")).agg(F.count(F.lit(1)).alias("n"))


def _settled(table: DataFrame) -> DataFrame:
    """The table evaluated once: in memory when small, in the checkpoint folder otherwise."""
    frame, rows = settle_small(table, 128)
    return cut_lineage(table) if rows is None else frame


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))


def _margins(table: DataFrame):
    cells = table.where("n > 0").groupBy("row_key", "col_key").agg(F.sum("n").cast("double").alias("n"))
    rows = cells.groupBy("row_key").agg(F.sum("n").alias("r"), F.max("n").alias("rmax"), F.count(F.lit(1)).alias("rc"))
    cols = cells.groupBy("col_key").agg(F.sum("n").alias("c"))
    return cells, rows, cols


def expected(table: DataFrame) -> DataFrame:
    """(row_key, col_key, n, e): every cell of a small full grid, empty ones included, with its expected count."""
    cells, rows, cols = _margins(table)
    total = cells.agg(F.sum("n")).scalar()
    names = cols.agg(F.collect_list(F.struct("col_key", "c")).alias("cols")).scalar()
    grid = rows.withColumn("cc", F.explode(names)).select("row_key", "r", F.col("cc.col_key").alias("col_key"), F.col("cc.c").alias("c"))
    full = grid.join(cells, ["row_key", "col_key"], "left")
    return full.select("row_key", "col_key", F.coalesce("n", F.lit(0.0)).alias("n"), (F.col("r") * F.col("c") / total).alias("e"))


def summary_counts(table: DataFrame) -> DataFrame:
    return table.where("n > 0").agg(F.sum("n").cast("double").alias("total"), F.countDistinct("row_key").alias("nr"),
                                    F.countDistinct("col_key").alias("nc"))


def chi_square(table: DataFrame, yates: bool = False) -> DataFrame:
    """(chi_square, df). The continuity correction applies to 2 x 2 tables only.

    Only occupied cells are visited: an empty cell adds its expected count, and all expected counts add up to n.
    """
    table = _settled(table)
    cells, rows, cols = _margins(table)
    total = cells.agg(F.sum("n")).scalar()
    seen = cells.join(rows.select("row_key", "r"), "row_key").join(cols, "col_key").withColumn(
        "e", F.col("r") * F.col("c") / total)
    gap = F.col("n") - F.col("e")
    stat = seen.agg((F.sum(gap * gap / F.col("e")) + F.sum("n") - F.sum("e")).alias("plain"))
    df = (F.col("nr") - 1) * (F.col("nc") - 1)
    out = summary_counts(table).select(df.alias("df"), stat.scalar().alias("plain"))
    if yates:
        cut = F.greatest(F.abs(F.col("n") - F.col("e")) - 0.5, F.lit(0.0))
        small = expected(table.where(summary_counts(table).select((F.col("nr") <= 2) & (F.col("nc") <= 2)).scalar()))
        out = out.withColumn("yates", small.agg(F.sum(cut * cut / F.col("e"))).scalar())
        value = F.when(F.col("df") == 1, F.col("yates")).otherwise(F.col("plain"))
    else:
        value = F.col("plain")
    return out.select(F.when(F.col("df") <= 0, F.lit(0.0)).otherwise(value).alias("chi_square"), "df")


def chi_square_test(df: DataFrame, row: str, col: str) -> DataFrame:
    """(statistic, df, p_value) of two columns, from their contingency table; any number of categories."""
    out = chi_square(contingency(df, row, col)).select(F.col("chi_square").alias("statistic"), "df")
    return out.withColumn("p_value", chi_square_tail(F.col("statistic"), F.col("df")))


def cramers_v(table: DataFrame) -> DataFrame:
    table = _settled(table)
    info = summary_counts(table)
    chi = chi_square(table).select("chi_square").scalar()
    least = F.least(F.col("nr"), F.col("nc")) - 1
    return info.select(F.coalesce(F.sqrt(F.try_divide(chi, F.col("total") * least)), F.lit(0.0)).alias("cramers_v"))


def cochran_criterion(table: DataFrame) -> DataFrame:
    """True unless an expected count is below 1 or more than a fifth of them are below 5.

    Expected counts depend on the margins only, so rows are met with the distinct column totals small enough to matter.
    """
    table = _settled(table)
    cells, rows, cols = _margins(table)
    total = cells.agg(F.sum("n")).scalar()
    rt = rows.groupBy("r").agg(F.count(F.lit(1)).alias("k"))
    least = rt.agg(F.min("r")).scalar()
    ct = cols.groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    thin = ct.where(F.col("c") * least < 5 * total).agg(F.collect_list(F.struct("c", "k"))).scalar()
    few = rt.withColumn("x", F.explode(thin)).where(F.col("r") * F.col("x.c") < 5 * total).agg(
        F.coalesce(F.sum(F.col("k") * F.col("x.k")), F.lit(0))).scalar()
    low = rt.agg(F.min("r").alias("r")).select((F.col("r") * ct.agg(F.min("c")).scalar() / total).alias("smallest"), few.alias("few"))
    cells_all = summary_counts(table).select(F.col("nr") * F.col("nc")).scalar()
    return low.select("smallest", "few", ((F.col("smallest") >= 1) & (F.col("few") <= cells_all / 5)).alias("fulfilled"))


def entropies(table: DataFrame) -> DataFrame:
    """(rows, columns, given_columns, given_rows) in bits, in one row."""
    table = _settled(table)
    cells, rows, cols = _margins(table)
    total = cells.agg(F.sum("n").alias("t"), F.sum(_xlogx(F.col("n"))).alias("cell"))
    r = rows.agg(F.sum(_xlogx(F.col("r")))).scalar()
    c = cols.agg(F.sum(_xlogx(F.col("c")))).scalar()
    t = F.col("t")
    return total.select(
        ((_xlogx(t) - r) / t).alias("over_rows"), ((_xlogx(t) - c) / t).alias("over_columns"),
        ((c - F.col("cell")) / t).alias("given_columns"), ((r - F.col("cell")) / t).alias("given_rows"))


def cross_entropy_on_rows(train: DataFrame, test: DataFrame, classes: float) -> DataFrame:
    """Cross-entropy of the test table under the Laplace-smoothed row distributions of the train table."""
    tr_rows = train.groupBy("row_key").agg(F.sum("n").cast("double").alias("tr"))
    both = test.where("n > 0").join(train.withColumnRenamed("n", "tn"), ["row_key", "col_key"], "left").join(tr_rows, "row_key", "left")
    cost = F.col("n") * (F.log2(F.coalesce("tr", F.lit(0.0)) + F.lit(float(classes))) - F.log2(F.coalesce("tn", F.lit(0)) + 1.0))
    return both.agg((F.sum(cost) / F.sum("n")).alias("cross_entropy"))


def gain_ratio(table: DataFrame) -> DataFrame:
    """Information gain of the rows about the columns over the rows' own entropy, and symmetrical uncertainty."""
    e = entropies(table)
    gain = F.col("over_columns") - F.col("given_rows")
    return e.select(
        F.coalesce(F.try_divide(gain, F.col("over_rows")), F.lit(0.0)).alias("gain_ratio"),
        F.coalesce(F.try_divide(2 * gain, F.col("over_rows") + F.col("over_columns")), F.lit(0.0)).alias("symmetrical_uncertainty"))


def goodman_kruskal_lambda(table: DataFrame) -> DataFrame:
    table = _settled(table)
    cells, rows, cols = _margins(table)
    top = cols.agg(F.max("c")).scalar()
    total = cells.agg(F.sum("n")).scalar()
    return rows.agg(F.coalesce(F.try_divide(F.sum("rmax") - top, total - top), F.lit(0.0)).alias("lambda"))


def hypergeometric_log2(table: DataFrame) -> DataFrame:
    """Negative log2 of the multiple hypergeometric probability of the table given its margins."""
    table = _settled(table)
    cells, rows, cols = _margins(table)
    ln = lambda c: log_gamma(F.col(c) + 1.0)
    total = cells.agg(F.sum("n").alias("t"), F.sum(ln("n")).alias("cell"))
    r = rows.agg(F.sum(ln("r"))).scalar()
    c = cols.agg(F.sum(ln("c"))).scalar()
    ln2 = 0.6931471805599453
    return total.select(((ln("t") + F.col("cell") - r - c) / ln2).alias("neg_log2_p"))
