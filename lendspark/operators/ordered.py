"""Value-ordered cumulative counts, computed without a global window.

A ``Window.orderBy`` with no partition moves every row into one task. Instead:

1. collapse ties: ``groupBy(groups, value)`` with per-class counts (partial
   aggregation runs map-side, so a value holding a third of all rows is one
   row after the combine). The table is kept, so the input is evaluated once;
2. split each group's value range into buckets. Splitters are quantiles of a hash
   sample of the collapsed values, found level by level: at most ``FAN`` blocks a
   level, then the blocks of every block, until a block holds about
   ``BUCKET_VALUES`` values. Every list and buffer has a fixed size at any input size,
   and a splitter table is joined on (group, block), never on the group alone beyond
   the first level;
3. running counts inside ``Window.partitionBy(groups, bucket).orderBy(value)``;
4. add per-bucket offsets from a ``(group, bucket)`` totals table.

Everything downstream (exact AUC / KS / Mann-Whitney U, exact quantiles, mid
ranks for Spearman) is a plain aggregate over this output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendspark.functions.nulls import col_of
from lendspark.session import cut_lineage

# Values (after nulls) of the largest group that one bucket should hold.
BUCKET_VALUES = 500_000
LEAST_BUCKETS = 8
FAN = 64                    # blocks that one level of splitters makes of a block
SAMPLE_FROM = 4_000_000     # values of the largest group up to which all of them are the sample
SAMPLE_ONE_IN = 1024        # beyond: FAN * BUCKET_VALUES / 1024 = 31,250 a block, about 500 a splitter
SMALL_TABLE = 20_000        # splitter arrays (512 bytes each) that are sent to all tasks


def collapse(df: DataFrame, value: str | Column, label: str | Column | None = None,
             groups: Sequence[str] = (), value_name: str = "value") -> DataFrame:
    """(groups, value, n[, c0, c1]): rows per distinct non-null value, kept in the shared
    folder. With a label, rows without one are dropped, and c0 / c1 count labels 0 / 1."""
    base = df.select(*[F.col(g) for g in groups], col_of(value).alias(value_name),
                     *([] if label is None else [col_of(label).alias("_label")])).where(F.col(value_name).isNotNull())
    counts = [F.count(F.lit(1)).alias("n")]
    if label is not None:
        base = base.where(F.col("_label").isNotNull())
        counts += [F.count_if(F.col("_label") == 0).alias("c0"), F.count_if(F.col("_label") == 1).alias("c1")]
    return cut_lineage(base.groupBy(*groups, value_name).agg(*counts))


def _count_below(arr: Column, v: Column) -> Column:
    """Number of elements of ``arr`` strictly below ``v``: the first position
    of ``v`` once it is sorted in with them, minus one. No lambda function
    (a lambda's variable would keep one id across the self-joins below)."""
    return (F.array_position(F.sort_array(F.concat(arr, F.array(v))), v) - 1).cast("long")


def with_buckets(collapsed: DataFrame, value_name: str, groups: Sequence[str] = (),
                 n_buckets: int | None = None) -> DataFrame:
    """Add ``_b``, a bucket number that rises with the value inside each group; equal
    values share a bucket. ``n_buckets``: buckets wanted in the largest group (default:
    as many as ``BUCKET_VALUES`` asks for)."""
    groups = list(groups)
    largest, n_groups = collapsed.groupBy(*groups).agg(F.count(F.lit(1)).alias("c")).agg(
        F.max("c"), F.count(F.lit(1))).first()
    wanted = n_buckets or max(LEAST_BUCKETS, -(-int(largest or 0) // BUCKET_VALUES))
    out = collapsed.withColumn("_b", F.lit(0).cast("long"))
    sample = out.select(*groups, value_name, "_b")
    if int(largest or 0) > SAMPLE_FROM:
        sample = cut_lineage(sample.where(F.pmod(F.xxhash64(*groups, value_name), F.lit(SAMPLE_ONE_IN)) == 0))
    tables = n_groups
    while True:
        fan = min(FAN, wanted)
        if fan > 1:
            ranks = [i / fan for i in range(1, fan)]
            cuts = (sample.groupBy(*groups, "_b")
                    .agg(F.percentile_approx(F.col(value_name), ranks, 64 * FAN).alias("_cuts"))
                    .withColumn("_cuts", F.array_distinct(F.col("_cuts").cast("array<double>"))))
            if tables <= SMALL_TABLE:
                cuts = F.broadcast(cuts)                # its number of rows is known
            split = lambda t: t.join(cuts, [*groups, "_b"], "left").withColumn(      # noqa: E731
                "_b", F.col("_b") * FAN + F.coalesce(_count_below(F.col("_cuts"), F.col(value_name).cast("double")),
                                                     F.lit(0).cast("long"))).drop("_cuts")
            out, sample = split(out), split(sample)
        tables *= FAN
        wanted = -(-wanted // FAN)
        if wanted <= 1:
            return out


def ordered_counts(df: DataFrame | None, value: str | Column, label: str | Column | None = None,
                   groups: Sequence[str] = (), n_buckets: int | None = None,
                   value_name: str = "value", collapsed: DataFrame | None = None) -> DataFrame:
    """One row per (groups, distinct value) with

    ``n`` rows at the value, ``before_n`` rows with a strictly smaller value,
    ``total_n`` rows in the group; with a 0/1 ``label`` also ``c0, c1``,
    ``before0, before1``, ``total0, total1``. Rows with a null value (or a null
    label) are dropped, as the reference drops null pairs. ``collapsed`` takes the
    output of :func:`collapse` when the caller already has it.
    """
    groups = list(groups)
    if collapsed is None:
        collapsed = collapse(df, value, label, groups, value_name)
    names = [c for c in ("n", "c0", "c1") if c in collapsed.columns]
    bucketed = with_buckets(collapsed, value_name, groups, n_buckets)

    w_in = (Window.partitionBy(*groups, "_b").orderBy(value_name)
            .rowsBetween(Window.unboundedPreceding, -1))
    within = bucketed.select(
        *groups, value_name, "_b", *names,
        *[F.coalesce(F.sum(k).over(w_in), F.lit(0)).alias(f"_in_{k}") for k in names])

    totals = bucketed.groupBy(*groups, "_b").agg(*[F.sum(k).alias(f"_bt_{k}") for k in names])
    w_off = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*groups)
    offsets = totals.select(
        *groups, "_b",
        *[F.coalesce(F.sum(f"_bt_{k}").over(w_off), F.lit(0)).alias(f"_off_{k}") for k in names],
        *[F.sum(f"_bt_{k}").over(w_all).alias(f"_tot_{k}") for k in names])

    # offsets has groups x buckets rows: how to join them is left to their measured size
    out = within.join(offsets, [*groups, "_b"])
    suffix = {"n": "n", "c0": "0", "c1": "1"}
    return out.select(
        *groups, value_name, *names,
        *[(F.col(f"_off_{k}") + F.col(f"_in_{k}")).alias(f"before_{suffix[k]}") for k in names],
        *[F.col(f"_tot_{k}").alias(f"total_{suffix[k]}") for k in names])


def quantile_parts(df: DataFrame, value: str | Column, probs: Sequence[float],
                   groups: Sequence[str] = (), n_buckets: int | None = None,
                   collapsed: DataFrame | None = None) -> DataFrame:
    """Per group: ``_N`` non-null rows, ``_D`` distinct values and, for every
    probability i, the values at 0-based positions floor(h) and ceil(h),
    h = (N - 1) p (``_lo{i}``, ``_hi{i}``) with the fraction ``_fr{i}``.

    Only the buckets holding a wanted rank are ordered: per-bucket totals
    (a groups x buckets table) locate the bucket and the rank inside it, a
    semi-join keeps that bucket's values (about 2 * len(probs) / buckets of
    them) and a window inside it finds the value."""
    groups = list(groups)
    if collapsed is None:
        collapsed = collapse(df, value, groups=groups, value_name="_v")
    else:
        collapsed = collapsed.withColumnRenamed(value, "_v")
    bucketed = with_buckets(collapsed, "_v", groups, n_buckets)

    totals = bucketed.groupBy(*groups, "_b").agg(F.sum("n").alias("_bn"),
                                                 F.count(F.lit(1)).alias("_bd"))
    w_off = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*groups)
    off = totals.select(*groups, "_b", "_bn",
                        F.coalesce(F.sum("_bn").over(w_off), F.lit(0)).alias("_off"),
                        F.sum("_bn").over(w_all).alias("_N"), F.sum("_bd").over(w_all).alias("_D"))
    n1 = F.col("_N") - 1
    targets = []
    for i, p in enumerate(probs):
        h = n1 * F.lit(float(p))
        for side, pos in ((0, F.floor(h)), (1, F.ceil(h))):
            targets.append(F.struct(F.lit(i).alias("q"), F.lit(side).alias("side"),
                                    (pos + 1).cast("long").alias("r"), (h - F.floor(h)).alias("fr")))
    # one row per (group, wanted rank): at most groups x 2 x len(probs) rows
    need = (off.select(*groups, "_b", "_bn", "_off", "_N", "_D", F.explode(F.array(*targets)).alias("t"))
               .where((F.col("t.r") > F.col("_off")) & (F.col("t.r") <= F.col("_off") + F.col("_bn")))
               .select(*groups, "_b", "_N", "_D", F.col("t.q").alias("q"), F.col("t.side").alias("side"),
                       F.col("t.fr").alias("fr"), (F.col("t.r") - F.col("_off")).alias("_rin")))
    keys = need.select(*groups, "_b").distinct()
    sel = bucketed.join(keys, [*groups, "_b"], "left_semi")
    w_in = Window.partitionBy(*groups, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cum = sel.select(*groups, "_b", "_v", F.sum("n").over(w_in).alias("_cum"))
    hit = cum.join(need, [*groups, "_b"]).where(F.col("_cum") >= F.col("_rin"))
    picked = hit.groupBy(*groups, "q", "side").agg(
        F.min("_v").alias("_x"), F.first("fr").alias("fr"),
        F.first("_N").alias("_N"), F.first("_D").alias("_D"))
    aggs = [F.first("_N").alias("_N"), F.first("_D").alias("_D")]
    for i in range(len(probs)):
        aggs += [F.max(F.when((F.col("q") == i) & (F.col("side") == 0), F.col("_x"))).alias(f"_lo{i}"),
                 F.max(F.when((F.col("q") == i) & (F.col("side") == 1), F.col("_x"))).alias(f"_hi{i}"),
                 F.max(F.when(F.col("q") == i, F.col("fr"))).alias(f"_fr{i}")]
    return picked.groupBy(*groups).agg(*aggs)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    groups: Sequence[str] = (), names: Sequence[str] | None = None,
                    n_buckets: int | None = None, collapsed: DataFrame | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas / numpy default),
    one row per group. Distributed: no group's values pass through one task."""
    g = quantile_parts(df, value, probs, groups=groups, n_buckets=n_buckets, collapsed=collapsed)
    names = list(names) if names else [f"q{p}" for p in probs]
    groups = list(groups)
    return g.select(*groups, *[
        (F.col(f"_lo{i}").cast("double")
         + F.col(f"_fr{i}") * (F.col(f"_hi{i}").cast("double") - F.col(f"_lo{i}").cast("double"))
         ).alias(n) for i, n in enumerate(names)])


def class_separation(df: DataFrame, score: str | Column, label: str | Column,
                     groups: Sequence[str] = (), n_buckets: int | None = None,
                     extra: dict[str, Column] | None = None) -> DataFrame:
    """Rank statistics of ``score`` between label 0 and label 1, per group:

    ``n0, n1``; ``u0`` (Mann-Whitney U of class 0: pairs with x0 > x1 plus half
    the ties); ``auc`` = P(score1 > score0) + ties/2; ``ks`` = max |F1 - F0|;
    ``tie_term`` = sum(t^3 - t) over tie groups; ``n_distinct`` distinct
    values; ``extra`` aggregates over the collapsed counts (``_v, n, c0, c1``).
    """
    oc = ordered_counts(df, score, label, groups=groups, n_buckets=n_buckets, value_name="_v")
    c0, c1 = F.col("c0").cast("double"), F.col("c1").cast("double")
    b0, b1 = F.col("before_0").cast("double"), F.col("before_1").cast("double")
    t0, t1 = F.col("total_0").cast("double"), F.col("total_1").cast("double")
    n = F.col("n").cast("double")
    g = oc.groupBy(*groups).agg(
        F.first("total_0").alias("n0"), F.first("total_1").alias("n1"),
        F.sum(c0 * (b1 + c1 / 2)).alias("u0"),
        F.sum(c1 * (b0 + c0 / 2)).alias("_u1"),
        F.max(F.abs(F.try_divide(b1 + c1, t1) - F.try_divide(b0 + c0, t0))).alias("ks"),
        F.sum(n * n * n - n).alias("tie_term"),
        F.count(F.lit(1)).alias("n_distinct"), *[c.alias(k) for k, c in (extra or {}).items()])
    return g.select(*groups, "n0", "n1", "u0", "n_distinct", *(extra or {}),
                    F.try_divide(F.col("_u1"), F.col("n0").cast("double") * F.col("n1")).alias("auc"),
                    "ks", "tie_term")


def hashed_row_numbers(df: DataFrame, groups: Sequence[str], order_key: Column,
                       out: str = "_rn", bits: int = 16) -> DataFrame:
    """0-based row number within ``groups`` in the order of a hash key,
    without a global window: the top ``bits`` of the (uniform, 60-bit) key split each
    group into 2^bits ordered buckets (a group of 10^12 rows gives ~1.5x10^7
    rows per window partition); offsets come from a bucket table of at most
    groups x 2^bits rows."""
    shift = 60 - bits
    keyed = df.withColumn("_k", order_key).withColumn("_hb", F.shiftright(F.col("_k"), shift))
    w = Window.partitionBy(*groups, "_hb").orderBy("_k")
    local = keyed.withColumn("_lrn", F.row_number().over(w) - 1)
    tot = keyed.groupBy(*groups, "_hb").agg(F.count(F.lit(1)).alias("_bn"))
    w_off = Window.partitionBy(*groups).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*groups, "_hb", F.coalesce(F.sum("_bn").over(w_off), F.lit(0)).alias("_off"),
                     F.sum("_bn").over(Window.partitionBy(*groups)).alias("_group_n"))
    res = local.join(off, [*groups, "_hb"])
    return res.withColumn(out, F.col("_off") + F.col("_lrn")).drop("_k", "_hb", "_lrn", "_off")
