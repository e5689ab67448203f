"""Metrics over prediction frames (y_true, y_pred, probabilities), as aggregations; all take grouping columns, so many models or folds are one query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalars import ratio
from tidegauge.operators.ranges import broadcast_if_small, mid_ranks, quantiles
from tidegauge.sources.sinks import written

#: Probabilities are clipped at the resolution of doubles.
EPS = 2.220446049250313e-16


def label_frame(df: DataFrame, labels: list[str]) -> DataFrame:
    """(label, rank) of a fixed list."""
    return df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, rank int")


def class_shares(df: DataFrame, label: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, label, n, share, is_majority): each class's rows and its share of the weight (of rows, without one) in its group; the majority is the class with the largest, ties to the first in order.

    Rows without a label don't count; null weights count as 0. Classes are few.
    """
    by = by or []
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    per = df.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("_w"))
    group = Window.partitionBy(*(by or [F.lit(1)]))  # a row a class
    best = F.row_number().over(group.orderBy(F.desc("_w"), label)) == 1
    return per.select(*by, label, "n", ratio(F.col("_w"), F.sum("_w").over(group)).alias("share"), best.cast("int").alias("is_majority"))


def recall_by_class(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, y_true, support, correct, recall)."""
    hit = (F.col("y_true") == F.col("y_pred")).cast("long")
    return df.groupBy(*(by or []), "y_true").agg(F.count(F.lit(1)).alias("support"), F.sum(hit).alias("correct"), F.avg(hit.cast("double")).alias("recall"))


def by_previous(df: DataFrame, previous: str, by: list[str] | None = None) -> DataFrame:
    """(by, previous, n, accuracy) of the forecast that nothing changes, by what was before; and a row with previous null and is_overall 1 over all."""
    hit = (F.col("y_true") == F.col(previous)).cast("double")
    keys = [F.col(c) for c in (by or [])]
    out = df.filter(F.col(previous).isNotNull()).groupingSets([[*keys, F.col(previous)], keys], *(by or []), previous)
    return out.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), (F.grouping(previous)).cast("int").alias("is_overall")).withColumnRenamed(previous, "previous")


def error_table(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """keys, y_true, y_pred and flags, the names of those that are set, joined by commas in the order given: a row for each wrong call."""
    own = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in flags.items()]))
    return df.filter("y_true <> y_pred").select(*keys, "y_true", "y_pred", F.array_join(own, ", ").alias("flags"))


def covered(df: DataFrame, call: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, n_covered, accuracy) of a benchmark's calls, over those rows where it has one."""
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.count(call).alias("n_covered"), F.avg((F.col("y_true") == F.col(call)).cast("double")).alias("accuracy"))


def top_share(df: DataFrame, key: str, value: str, top: int) -> DataFrame:
    """(key, value, share): the keys with the largest values, ties by key, with their share of the sum over all. A row a key."""
    total = df.agg(F.sum(value).alias("_t"))
    return df.crossJoin(F.broadcast(total)).select(key, value, ratio(F.col(value), F.col("_t")).alias("share")).orderBy(F.desc_nulls_last(value), key).limit(top)


def run_report(predictions: DataFrame, labels: list[str], run_id: str, fold: str = "fold", proba: dict[str, Column] | None = None, market: str | None = None) -> DataFrame:
    """run_id, fold, is_overall and the metrics of :func:`bundle`, a row a fold and one over all; with a benchmark's calls also n_paired, market_hit_rate and lift over the rows where it has one."""
    out = bundle(predictions, labels, [fold], proba)
    if market:
        a, b = ((F.col("y_true") == F.col(c)).cast("double") for c in ("y_pred", market))
        pairs = predictions.filter(F.col(market).isNotNull() & F.col("y_pred").isNotNull() & F.col("y_true").isNotNull()).groupingSets([[F.col(fold)], []], fold)
        told = pairs.agg(F.count(F.lit(1)).alias("n_paired"), F.avg(b).alias("market_hit_rate"), (F.avg(a) - F.avg(b)).alias("lift"), F.grouping(fold).cast("int").alias("_o")).withColumnRenamed(fold, "_f")
        out = out.join(F.broadcast(told), out[fold].eqNullSafe(told["_f"]) & (out["is_overall"] == told["_o"]), "left").drop("_f", "_o")  # a row a fold
        out = out.withColumn("n_paired", F.coalesce("n_paired", F.lit(0).cast("long")))
    return out.select(F.lit(run_id).alias("run_id"), *out.columns)


def confusion(df: DataFrame, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """y_true with one count for each label predicted; labels that never come are rows and columns of zeros."""
    by = by or []
    rows = label_frame(df, labels).select(F.col("label").alias("y_true"))
    counts = df.groupBy(*by, "y_true").pivot("y_pred", labels).agg(F.count(F.lit(1)))
    keys = df.select(*by).distinct().crossJoin(F.broadcast(rows)) if by else rows
    return keys.join(counts, [*by, "y_true"], "left").select(*by, "y_true", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(x) for x in labels])


def class_counts(df: DataFrame, by: list[str], labels: list[str]) -> DataFrame:
    """by, label, tp, fp, fn: one row for each label that is true or predicted somewhere."""
    both = df.select(*by, F.explode(F.array_distinct(F.array("y_true", "y_pred"))).alias("label"), "y_true", "y_pred").filter(F.col("label").isin(labels))
    hit = (F.col("y_true") == F.col("y_pred")) & (F.col("label") == F.col("y_true"))
    return both.groupBy(*by, "label").agg(F.sum(hit.cast("long")).alias("tp"), F.sum(((F.col("label") == F.col("y_pred")) & ~hit).cast("long")).alias("fp"), F.sum(((F.col("label") == F.col("y_true")) & ~hit).cast("long")).alias("fn"))


def classification(df: DataFrame, labels: list[str], by: list[str]) -> DataFrame:
    """by, n, accuracy, balanced_accuracy (over labels that occur) and macro_f1 (over all labels, 0 for those without any)."""
    per = class_counts(df, by, labels)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    over = per.groupBy(*by).agg(F.avg(recall).alias("balanced_accuracy"), (F.sum(f1) / len(labels)).alias("macro_f1"))
    plain = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    return plain.join(over, by) if by else plain.crossJoin(over)


def log_loss(p_true: Column) -> Column:
    """The mean of -ln of the true class's probability."""
    return F.avg(-F.log(F.greatest(F.least(p_true, F.lit(1 - EPS)), F.lit(EPS))))


def brier(proba: dict[str, Column]) -> Column:
    """The mean over rows of the squared distance to the true class's unit vector: 0 to 2."""
    return F.avg(sum(((p - (F.col("y_true") == label).cast("double")) ** 2 for label, p in proba.items()), F.lit(0.0)))


def regression(df: DataFrame, by: list[str]) -> DataFrame:
    """by, rmse, mae, r2 and directional accuracy of y_pred against y_true."""
    e = F.col("y_true") - F.col("y_pred")
    return df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - ratio(F.sum(e * e), F.var_pop("y_true") * F.count("y_true"))).alias("r2"), F.avg((F.signum("y_true") == F.signum("y_pred")).cast("double")).alias("directional_accuracy"))


def paired(df: DataFrame, by: list[str]) -> DataFrame:
    """Hit rates of y_pred and y_market over rows where all three are known, their lift, and the shares of rows that both, one or neither hit."""
    rows = df.filter("y_true is not null and y_pred is not null and y_market is not null")
    a, b = F.col("y_true") == F.col("y_pred"), F.col("y_true") == F.col("y_market")
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share(a).alias("hit_rate"), share(b).alias("market_hit_rate"), (share(a) - share(b)).alias("lift"), share(a & b).alias("both"), share(a & ~b).alias("only_model"), share(~a & b).alias("only_market"), share(~a & ~b).alias("neither"))


def bundle(df: DataFrame, labels: list[str], by: list[str], proba: dict[str, Column] | None = None, sets: list[list[str]] | None = None) -> DataFrame:
    """by, is_overall, n, accuracy, balanced_accuracy, macro_f1, and log_loss and brier with probabilities: a row a group and one over all, in one scan.

    sets: other sets of the grouping columns to have rows for, as (model, fold) and (model); columns outside a row's set are null, and is_overall tells
    rows of smaller sets than the first from groups whose column is null itself. Without rows there is no row over all but one of nulls with n 0.
    """
    sets = sets or [by, []]
    true, called = F.col("y_true"), F.col("y_pred")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    cells = [x for i, v in enumerate(labels) for x in (count((true == v) & (called == v)).alias(f"_tp{i}"), count((true == v) & (called != v)).alias(f"_fn{i}"), count((true != v) & (called == v)).alias(f"_fp{i}"))]
    scores = []
    if proba:
        own = F.coalesce(*[F.when(true == v, c) for v, c in proba.items()])
        scores = [log_loss(own).alias("log_loss"), brier(proba).alias("brier")]
    table = df.groupingSets([[F.col(c) for c in x] for x in sets], *by).agg(F.count(F.lit(1)).alias("n"), F.avg((true == called).cast("double")).alias("accuracy"), *cells, *scores, F.grouping_id(*by).alias("_set"))
    whole = sum(1 << (len(by) - 1 - i) for i, c in enumerate(by) if c not in sets[0])
    of = lambda i: (F.col(f"_tp{i}"), F.col(f"_fn{i}"), F.col(f"_fp{i}"))
    recalls = F.array_compact(F.array(*[F.try_divide(tp, tp + fn) for tp, fn, _ in map(of, range(len(labels)))]))
    recall = F.when(F.size(recalls) > 0, F.aggregate(recalls, F.lit(0.0), lambda x, v: x + v) / F.size(recalls))
    f1 = sum((F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fn + fp), F.lit(0.0)) for tp, fn, fp in map(of, range(len(labels)))), F.lit(0.0)) / len(labels)
    return table.select(*by, (F.col("_set") != whole).cast("int").alias("is_overall"), "n", "accuracy", recall.alias("balanced_accuracy"), f1.alias("macro_f1"), *(["log_loss", "brier"] if proba else []))


def reliability(df: DataFrame, p: str, hit: str, edges: list[float] | DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, bin, low, high, n, mean_pred, observed): left-closed bins between edges, the last edge in the last bin; empty bins have n 0 and nulls.

    edges: one list for all, or a table (by, edges) of each group's own. A value's bin is how many inner edges are at or below it, by comparison with the
    very doubles given, as 0.3 * 10 would round otherwise. by holds no nulls.
    """
    by = by or []
    if isinstance(edges, list):
        own = F.array(*[F.lit(float(x)) for x in edges]).alias("edges")
        table = df.select(*by).distinct().withColumn("edges", own) if by else df.sparkSession.range(1).select(own)
    else:
        table = edges
    table = broadcast_if_small(written(table, "edges"))
    inner = F.slice("edges", F.lit(2), F.size("edges") - 2)
    rows = df.select(*by, p, hit).filter(F.col(p).isNotNull())
    rows = rows.join(table, by) if by else rows.crossJoin(F.broadcast(table))  # one row
    at = F.size(F.filter(inner, lambda e: e <= F.col(p)))
    stats = rows.groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(F.col(hit).cast("double")).alias("observed"))
    bins = table.select(*by, "edges", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin")).select(*by, "bin", F.get("edges", F.col("bin")).alias("low"), F.get("edges", F.col("bin") + 1).alias("high"))
    return bins.join(stats, [*by, "bin"], "left").select(*by, "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), "mean_pred", "observed")


def quantile_edges(df: DataFrame, p: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """(by, edges): edges of so many bins of equal counts, by exact interpolated quantiles; equal edges collapse, so there may be fewer bins. The first is 0 and the last 1."""
    by = by or []
    inner = quantiles(df, [p], [i / bins for i in range(1, bins)], by).groupBy(*by).agg(F.collect_set(F.least(F.greatest("value", F.lit(0.0)), F.lit(1.0))).alias("q"))
    edges = F.array_sort(F.array_union(F.coalesce("q", F.array().cast("array<double>")), F.array(F.lit(0.0), F.lit(1.0)))).alias("edges")  # a few a group
    return (df.select(*by).distinct().join(inner, by, "left") if by else inner).select(*by, edges)


def leaderboard(table: DataFrame, by: list[str]) -> DataFrame:
    """A table of models (few rows) with their place by these scores, largest first, nulls last, then by name."""
    return table.withColumn("place", F.row_number().over(Window.orderBy(*[F.desc_nulls_last(c) for c in by], "model")))


def calibration_errors(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, ece, mce) of a reliability table."""
    gap = F.abs(F.col("mean_pred") - F.col("observed"))
    return table.filter("n > 0").groupBy(*(by or [])).agg(ratio(F.sum(F.col("n") * gap), F.sum("n").cast("double")).alias("ece"), F.max(gap).alias("mce"))


def sliced(df: DataFrame, flags: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, flag, n_on, accuracy_on, n_off, accuracy_off) of 0/1 flags that are neither always nor never on, in a group."""
    by = by or []
    long = df.select(*by, (F.col("y_true") == F.col("y_pred")).cast("double").alias("hit"), *flags).unpivot([*by, "hit"], flags, "flag", "is_on")
    on, off = (F.when(F.col("is_on") == x, F.col("hit")) for x in (1, 0))
    return long.groupBy(*by, "flag").agg(F.count(on).alias("n_on"), F.avg(on).alias("accuracy_on"), F.count(off).alias("n_off"), F.avg(off).alias("accuracy_off")).filter("n_on > 0 and n_off > 0")


def _pairs(df: DataFrame, features: list[str], target: str) -> tuple[DataFrame, Row, DataFrame]:
    """Rows with a known target (_y), all as doubles; one row of figures over them; and of these (feature, n_obs, pearson, _varies)."""
    rows = df.select(F.col(f"`{target}`").cast("double").alias("_y"), *[F.col(f"`{c}`").cast("double").alias(c) for c in features]).filter("_y is not null")

    def told(c: str) -> tuple[Column, ...]:
        y = F.when(F.col(c).isNotNull(), F.col("_y"))
        return F.count(c), ratio(F.covar_pop(c, "_y"), F.stddev_pop(c) * F.stddev_pop(y)), (F.min(c) < F.max(c)) & (F.min(y) < F.max(y))

    row = rows.agg(F.count(F.lit(1)).alias("_n"), *[x.alias(f"{c}{i}") for c in features for i, x in enumerate(told(c))]).head()
    summary = df.sparkSession.createDataFrame([(c, row[f"{c}0"], row[f"{c}1"] if row[f"{c}2"] else None, bool(row[f"{c}2"])) for c in features], "feature string, n_obs long, pearson double, _varies boolean")
    return rows, row, summary


def correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, n_obs, pearson) as of :func:`associations`, from one scan: nothing is ranked."""
    return _pairs(df, features, target)[2].drop("_varies")


def associations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, n_obs, pearson, spearman) over rows where both are known; correlations need two distinct values of each.

    The target is ranked once for all features without nulls, and once for each other. Rows get its rank by one join, and sums of ranks by feature and value are all that is kept of
    them; so a feature of few values is ranked from a few counts.
    """
    rows, row, summary = _pairs(df, features, target)
    full = [c for c in features if row[f"{c}0"] == row["_n"]]
    rest = [c for c in features if c not in full and row[f"{c}0"]]
    long = rows.unpivot("_y", rest, "feature", "x").filter("x is not null") if rest else None
    counts = [x for x in (rows.select(F.lit("").alias("p"), "_y") if full else None, long.select(F.col("feature").alias("p"), "_y") if rest else None) if x is not None]
    if not counts:
        return summary.select("feature", "n_obs", "pearson", F.lit(None).cast("double").alias("spearman"))
    every = counts[0] if len(counts) == 1 else counts[0].unionByName(counts[1])
    ranks = written(mid_ranks(every.groupBy("p", "_y").agg(F.count(F.lit(1)).alias("n")), ["p"], "_y", most_rows=row["_n"] * (len(rest) + 1)).withColumnRenamed("rank", "ry"), "ranks")
    sums = []
    if full:
        wide = rows.join(ranks.filter("p = ''").select("_y", "ry"), "_y")
        sums.append(wide.select("ry", *full).unpivot("ry", full, "feature", "x"))
    if rest:
        sums.append(long.join(ranks.select(F.col("p").alias("feature"), "_y", "ry"), ["feature", "_y"]).select("ry", "feature", "x"))
    both = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1])
    cells = mid_ranks(both.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("ry").alias("s")), ["feature"], "x", most_rows=row["_n"] * len(features))
    own = cells.join(F.broadcast(summary), "feature")  # a row a feature
    middle = (F.col("n_obs") + 1) / 2
    xs = own.groupBy("feature").agg(F.sum((F.col("rank") - middle) * (F.col("s") - F.col("n") * middle)).alias("xy"), F.sum(F.col("n") * (F.col("rank") - middle) ** 2).alias("xx"))
    total = ranks.groupBy("p").agg(F.sum("n").alias("t"))
    ys = ranks.join(F.broadcast(total), "p").groupBy("p").agg(F.sum(F.col("n") * (F.col("ry") - (F.col("t") + 1) / 2) ** 2).alias("yy"))
    pattern = F.when(F.col("feature").isin(full), "").otherwise(F.col("feature"))
    out = summary.withColumn("p", pattern).join(F.broadcast(xs), "feature", "left").join(F.broadcast(ys), "p", "left")
    return out.select("feature", "n_obs", "pearson", F.when(F.col("_varies"), ratio(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))).alias("spearman"))


def by_slice(df: DataFrame, name: str, slice_: Column, by: list[str] | None = None) -> DataFrame:
    """(by, name, n, accuracy) of every slice; rows without one are left out."""
    hit = (F.col("y_true") == F.col("y_pred")).cast("double")
    return df.withColumn(name, slice_).filter(F.col(name).isNotNull()).groupBy(*(by or []), name).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def imputed(df: DataFrame, features: list[str]) -> DataFrame:
    """df with the nulls of features replaced by their medians, which are exact; a feature without values stays null. A row a feature comes to the driver."""
    known = {r["feature"]: r["value"] for r in quantiles(df, features, [0.5]).collect()}
    return df.fillna(known) if known else df


def quantile_bins(df: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """df with continuous features replaced by the number of their bin, of equal counts by exact quantiles; null stays null."""
    found: dict[str, set[float]] = {c: set() for c in features}
    for r in quantiles(df, features, [i / bins for i in range(1, bins)]).collect():  # a few rows a feature
        found[r["feature"]].add(r["value"])
    return df.withColumns({c: F.when(F.col(c).isNotNull(), sum(((F.col(c) > F.lit(e)).cast("int") for e in sorted(found[c])), F.lit(0))) for c in features})


def mutual_information(df: DataFrame, features: list[str], label: str, least: int = 30) -> DataFrame:
    """(feature, mi) in nats of discrete features and a label, from their joint counts; null values left out. Features with fewer than ``least`` observations get null.

    Continuous features go through :func:`quantile_bins` first, or to ``information.continuous_information``.
    """
    long = df.select(F.col(label).cast("string").alias("y"), *[F.col(c).cast("string").alias(c) for c in features]).unpivot("y", features, "feature", "x").filter("x is not null and y is not null")
    return information_of_counts(long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n")), least)


def information_of_counts(joint: DataFrame, least: int = 30) -> DataFrame:
    """:func:`mutual_information` of joint counts (feature, x, y, n), none of them null."""
    of = lambda *c: F.sum("n").over(Window.partitionBy("feature", *c))
    cells = joint.withColumn("n", F.col("n").cast("double")).select("feature", "n", of().alias("t"), of("x").alias("nx"), of("y").alias("ny"))
    mi = F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny"))))
    return cells.groupBy("feature").agg(F.when(F.sum("n") >= least, mi).alias("mi"))


def anova_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, f) of the one-way analysis of variance, from grouped sums; null where within-group variance is zero."""
    long = df.select(F.col(label).alias("y"), *[F.col(c).cast("double").alias(c) for c in features]).unpivot("y", features, "feature", "x").filter("x is not null and y is not null")
    group = long.groupBy("feature", "y").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    all_ = group.withColumn("gm", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("feature")) / F.sum("n").over(Window.partitionBy("feature")))
    ssb, ssw, k, n = F.sum(F.col("n") * (F.col("m") - F.col("gm")) ** 2), F.sum(F.col("n") * F.col("v")), F.count(F.lit(1)), F.sum("n")
    return all_.groupBy("feature").agg(ratio(F.try_divide(ssb, (k - 1).cast("double")), F.try_divide(ssw, (n - k).cast("double"))).alias("f"))


def ranked(scores: DataFrame, by: list[str], top: int) -> DataFrame:
    """The first features by the sizes of these scores, nulls last, then by name."""
    return scores.orderBy(*[F.abs(F.col(c)).desc_nulls_last() for c in by], "feature").limit(top)


def suite(df: DataFrame, members: dict[str, str], labels: list[str], benchmark: str | None = None) -> DataFrame:
    """One row for each model (a column of predictions each): classification metrics and lift over a benchmark column, all in one query."""
    models = F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).alias("y_pred")) for name, c in members.items()])
    rows = df.withColumn("_m", F.explode(models)).select(*[c for c in df.columns if c not in ("y_pred", "model")], "_m.model", "_m.y_pred").filter("y_pred is not null")
    out = classification(rows, labels, ["model"])
    if benchmark is None:
        return out
    lift = paired(rows.withColumn("y_market", F.col(benchmark)), ["model"]).select("model", "lift")
    return out.join(lift, "model", "left")
