"""Learned models by fold, with Spark ML: imputation and scaling are fitted inside each fold, fits are distributed, folds and parameters are few."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.baselines import best_weights, tuned_weights, weighted_choice
from tidegauge.operators.evaluate import anova_f, calibration_errors, correlations, imputed, leaderboard, log_loss, reliability, suite
from tidegauge.operators.features import Panel
from tidegauge.operators.information import information
from tidegauge.sources.sinks import written

SEED = 12


def model(kind: str, features: list[str], n_classes: int, **params) -> Pipeline:
    """A pipeline from feature columns to a prediction of ``label`` (0, 1, ...): logistic, forest, boosted or perceptron."""
    own = {"featuresCol": "scaled", "labelCol": "label"}
    learner = {
        "logistic": lambda: LogisticRegression(**own, **{"maxIter": 30, "regParam": 0.01} | params),
        "forest": lambda: RandomForestClassifier(**own, seed=SEED, **{"numTrees": 20, "maxDepth": 5} | params),
        "boosted": lambda: OneVsRest(classifier=GBTClassifier(**own, seed=SEED, **{"maxIter": 5, "maxDepth": 3} | params), **own),
        "perceptron": lambda: MultilayerPerceptronClassifier(**own, seed=SEED, layers=[len(features), 8, n_classes], **{"maxIter": 30} | params),
    }[kind]()
    filled = [f"{c}_filled" for c in features]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="assembled"), StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True), learner])


def predicted(fitted: PipelineModel, test: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, prediction and proba (in label order; null for learners without probabilities)."""
    out = fitted.transform(test)
    proba = vector_to_array("probability") if "probability" in out.columns else F.lit(None).cast("array<double>")
    return out.select(*keys, F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction"), proba.alias("proba"))


#: What readies a fold's training and test rows, learnt on the training rows alone.
Prepare = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def fold_predictions(df: DataFrame, fold: tuple, k: int, at: str, build: Callable[..., Pipeline], keys: list[str], choose: Callable[[DataFrame], list[str]] | None = None, prepare: Prepare | None = None) -> DataFrame:
    """Predictions of one fold, (start, end) of ``at``, end exclusive, by a fit on the rows before it."""
    start, end = fold
    train, test = df.filter(F.col(at) < F.lit(start)), df.filter((F.col(at) >= F.lit(start)) & (F.col(at) < F.lit(end)))
    if prepare:
        train, test = prepare(train, test)
    fitted = build(*([choose(train)] if choose else [])).fit(train)
    return predicted(fitted, test, keys).withColumn("fold", F.lit(k))


def walk_forward(df: DataFrame, folds: Iterable[tuple], at: str, build: Callable[..., Pipeline], keys: list[str], choose: Callable[[DataFrame], list[str]] | None = None, prepare: Prepare | None = None) -> DataFrame:
    """Predictions of every fold, each by a fresh fit on rows before it; folds: (start, end) of ``at``, end exclusive.

    choose: selects features on the fold's own training rows, and build takes them. prepare: see :func:`forward_fills`.
    """
    out = None
    for k, fold in enumerate(folds):
        own = fold_predictions(df, fold, k, at, build, keys, choose, prepare)
        out = own if out is None else out.unionByName(own)
    return out


def forward_fills(p: Panel, columns: list[str]) -> Prepare:
    """A prepare that fills nulls of columns forward within the training rows and within the test rows, before the first value with the entity's last training value, else with 0.

    Test rows never fill training rows; entities without training rows have no carry.
    """

    def prepare(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
        place = F.struct(*p.order)
        carry = train.groupBy(*p.entity).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_carry_{i}") for i, c in enumerate(columns)])
        out = []
        for rows in (train, test):
            joined = rows.join(carry, [*p.entity], "left")
            fill = {c: F.coalesce(F.last(c, ignorenulls=True).over(p.so_far), f"_carry_{i}", F.lit(0.0)) for i, c in enumerate(columns)}
            out.append(joined.withColumns(fill).select(*rows.columns))
        return out[0], out[1]

    return prepare


def holdout_folds(df: DataFrame, at: str, since, months: int) -> list[tuple]:
    """(start, end) from a day on to the last row's, so many months each: a fresh fit for each on all rows before it. As few as the held-out span has periods."""
    last = df.agg(F.max(at).alias("d")).head()["d"]
    out, start = [], since
    while last is not None and start <= last:
        month = start.month - 1 + months
        end = start.replace(year=start.year + month // 12, month=month % 12 + 1)
        out.append((start, end))
        start = end
    return out


def grid(kind: str, features: list[str], n_classes: int, params: dict[str, list]) -> dict[str, Callable[[], Pipeline]]:
    """Candidates of a learner by the names of their parameters' values."""
    names = sorted(params)
    points = list(itertools.product(*(params[x] for x in names)))
    return {",".join([kind, *(f"{x}={v}" for x, v in zip(names, p, strict=True))]): (lambda p=p: model(kind, features, n_classes, **dict(zip(names, p, strict=True)))) for p in points}


def sampled(kind: str, features: list[str], n_classes: int, space: dict[str, list | tuple], trials: int, seed: int = SEED) -> dict[str, Callable[[], Pipeline]]:
    """So many candidates with parameters drawn at random, the same for the same seed. space: by name a list to choose from, or (low, high), or (low, high, "log") for a
    draw between; whole numbers if both ends are. Draws that come twice are one candidate."""
    rng, out = random.Random(seed), {}

    def draw(of):
        if isinstance(of, list):
            return rng.choice(of)
        low, high, *how = of
        v = math.exp(rng.uniform(math.log(low), math.log(high))) if how else rng.uniform(low, high)
        return min(high, max(low, round(v))) if isinstance(low, int) and isinstance(high, int) else v

    for _ in range(trials):
        own = {x: draw(space[x]) for x in sorted(space)}
        name = ",".join([kind, *(f"{x}={v:.6g}" if isinstance(v, float) else f"{x}={v}" for x, v in own.items())])
        out.setdefault(name, lambda own=own: model(kind, features, n_classes, **own))
    return out


def at_once(spark, jobs: list[Callable], most: int = 4) -> list:
    """The results of jobs that run side by side, each in a scheduler pool of its own, so that small fits share the cluster. Errors of any are raised."""

    def run(k: int, job: Callable):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{k % most}")
        return job()

    with ThreadPoolExecutor(max_workers=most) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(run), k, job) for k, job in enumerate(jobs)]]


def campaign(df: DataFrame, folds: list[tuple], at: str, members: dict[str, dict[str, Callable[[], Pipeline]]], keys: list[str], labels: list[str], steps: list[float]) -> DataFrame:
    """(model, candidate, fold, keys, y_true, y_pred, weighted, proba): every model tuned by log-loss over the folds, its best candidate's out-of-fold
    probabilities, and the labels chosen with class weights that are tuned on them by balanced accuracy.

    members: the candidates of each model. Labels are in the order of their numbers, and sorted.
    """
    out = None
    for name, candidates in members.items():
        done = trials(df, folds, at, candidates, keys)
        best = scored(done).orderBy(*[how(c) for how, c in BEST_FIRST]).head()["candidate"]
        own = done.filter(F.col("candidate") == best)
        named = F.array(*map(F.lit, labels))
        wide = own.select(*keys, "fold", "proba", F.get(named, F.col("label").cast("int")).alias("y_true"), F.get(named, F.col("prediction").cast("int")).alias("y_pred"), *[F.get("proba", F.lit(i)).alias(f"p_{x}") for i, x in enumerate(labels)])
        proba = {x: f"p_{x}" for x in labels}
        weights = best_weights(tuned_weights(wide, proba, steps), "balanced_accuracy", labels)
        wide = wide.withColumn("weighted", weighted_choice({x: F.col(c) for x, c in proba.items()}, weights))
        wide = wide.select(F.lit(name).alias("model"), F.lit(best).alias("candidate"), "fold", *keys, "y_true", "y_pred", "weighted", "proba")
        out = wide if out is None else out.unionByName(wide)
    return out


def scored(predictions: DataFrame) -> DataFrame:
    """(candidate, folds, accuracy, balanced_accuracy, log_loss) of predictions by candidate and fold: log-loss is the mean over folds, the others pool all rows."""
    recall = predictions.groupBy("candidate", "label").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("r"), F.count(F.lit(1)).alias("n"))
    table = recall.groupBy("candidate").agg((F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("accuracy"), F.avg("r").alias("balanced_accuracy"))
    loss = predictions.groupBy("candidate", "fold").agg(log_loss(F.get("proba", F.col("label").cast("int"))).alias("l")).groupBy("candidate").agg(F.count(F.lit(1)).alias("folds"), F.avg("l").alias("log_loss"))
    return table.join(F.broadcast(loss), "candidate").select("candidate", "folds", "accuracy", "balanced_accuracy", "log_loss")


BEST_FIRST = (F.desc, "folds"), (F.asc_nulls_last, "log_loss"), (F.desc, "balanced_accuracy"), (F.asc, "candidate")


def trials(df: DataFrame, folds: list[tuple], at: str, candidates: dict[str, Callable[[], Pipeline]], keys: list[str], keep: float = 1.0, most: int = 4) -> DataFrame:
    """Predictions of every candidate and fold, with candidate and fold; see :func:`search`. Predictions of a fold are written once, so no fit is done twice."""
    spark, left, done = df.sparkSession, list(candidates), None
    for k, fold in enumerate(folds):
        jobs = [lambda name=name: written(fold_predictions(df, fold, k, at, candidates[name], keys).withColumn("candidate", F.lit(name)), "trial") for name in left]
        for own in at_once(spark, jobs, most):
            done = own if done is None else done.unionByName(own)
        if keep < 1 and k + 1 < len(folds):
            table = scored(done.filter(F.col("candidate").isin(left))).orderBy(*[how(c) for how, c in BEST_FIRST])
            left = [r["candidate"] for r in table.limit(max(1, math.ceil(keep * len(left)))).collect()]  # names of candidates
    return done


def search(df: DataFrame, folds: list[tuple], at: str, candidates: dict[str, Callable[[], Pipeline]], keys: list[str], keep: float = 1.0, most: int = 4) -> DataFrame:
    """(candidate, folds, accuracy, balanced_accuracy, log_loss), best first: those that were tried on most folds, by log-loss (the mean over folds; last where a learner has no
    probabilities), then balanced accuracy. Out-of-fold scores of a grid or a sample of parameters.

    keep: after each fold only that share of the candidates, by the same order over the folds so far, goes on to the next (successive halving); one at least. Candidates
    of a fold are fitted side by side, ``most`` at a time.
    """
    return scored(trials(df, folds, at, candidates, keys, keep, most)).orderBy(*[how(c) for how, c in BEST_FIRST])


def aligned(proba: str, labels: list, every: list):
    """A probability array in the order of all classes; classes that a fold didn't know have 0."""
    return F.array(*[F.get(F.col(proba), F.lit(labels.index(x))) if x in labels else F.lit(0.0) for x in every])


def soft_vote(members: list[DataFrame], keys: list[str], weights: list[float] | None = None, n_classes: int | None = None) -> DataFrame:
    """keys, label, the weighted mean of the members' probabilities, and its first largest class.

    n_classes: the longest array of probabilities, found in a scan of all members if it isn't given. Members are summed class by class as columns, a row a key and member, over as many
    partitions as shuffles have, so that a task's rows are few.
    """
    weights = weights or [1.0] * len(members)
    every = None
    for df, w in zip(members, weights, strict=True):
        own = df.select(*keys, "label", "proba", F.lit(w).alias("w"))
        every = own if every is None else every.unionByName(own)
    if n_classes is None:
        n_classes = every.agg(F.max(F.size("proba")).alias("n")).head()["n"] or 0
    every = every.filter(F.size("proba") > 0).repartition(int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    sums = [[F.sum(F.get("proba", F.lit(i)) * F.col("w")).alias(f"_p{i}"), F.sum(F.when(F.size("proba") > i, F.col("w"))).alias(f"_w{i}")] for i in range(n_classes)]
    found = every.groupBy(*keys, "label").agg(F.max(F.size("proba")).alias("_n"), *itertools.chain(*sums))
    mean = F.slice(F.array(*[F.col(f"_p{i}") / F.col(f"_w{i}") for i in range(n_classes)]).cast("array<double>"), F.lit(1), F.col("_n"))
    arrays = found.select(*keys, "label", mean.alias("proba"))
    return arrays.withColumn("prediction", (F.array_position("proba", F.array_max("proba")) - 1).cast("double"))


def stacked(members: dict[str, DataFrame], keys: list[str], n_classes: int) -> DataFrame:
    """keys, label and a column <member>__<class> for each member's out-of-fold probability: what a meta learner is fitted on."""
    out = None
    for name, df in members.items():
        own = df.select(*keys, "label", *[F.get("proba", F.lit(i)).alias(f"{name}__{i}") for i in range(n_classes)])
        out = own if out is None else out.join(own.drop("label"), keys)
    return out


def selection_scores(df: DataFrame, features: list[str], target: str, by: str) -> DataFrame:
    """(feature, score) by the absolute correlation with the target, the F of its classes, or their mutual information; nulls of features count as their medians."""
    rows = imputed(df, features)
    if by == "correlation":
        return correlations(rows, features, target).select("feature", F.abs("pearson").alias("score"))
    if by == "f":
        return anova_f(rows, features, target).select("feature", F.col("f").alias("score"))
    if by == "information":
        return information(rows, features, target, least=1).select("feature", F.col("mi").alias("score"))
    raise ValueError(f"no score {by!r}")


def selected(df: DataFrame, features: list[str], target: str, k: int, by: str = "correlation") -> list[str]:
    """The k features with the largest scores (see :func:`selection_scores`), to nine digits; ties, and features without a score at the end, in the order given."""
    found = {r["feature"]: r["score"] for r in selection_scores(df, features, target, by).collect()}  # a row a feature
    score = lambda c: -math.inf if found.get(c) is None else round(found[c], 9)
    return sorted(features, key=lambda c: (-score(c), features.index(c)))[:k]


def model_table(df: DataFrame, members: dict[str, str], labels: list[str], proba: dict[str, dict[str, str]], benchmark: str | None = None, baselines: tuple[str, ...] = (), bins: int = 10) -> DataFrame:
    """A row a model, best balanced accuracy first: n, accuracy, balanced_accuracy, macro_f1, ece, lift, place and is_best_learned.

    members: the column of each model's labels; proba: those of its probabilities by class, for models that have them; their expected calibration error is the mean over classes. baselines:
    members that weren't learnt, so aren't the best learned one. lift: over the benchmark column's hits.
    """
    table = suite(df, members, labels, benchmark)
    cells = [F.struct(F.lit(m).alias("model"), F.lit(k).alias("label"), F.col(c).cast("double").alias("q")) for m, own in proba.items() for k, c in own.items()]
    if cells:
        chances = df.select("y_true", F.explode(F.array(*cells)).alias("c")).select("c.*", (F.col("y_true") == F.col("c.label")).cast("int").alias("hit"))
        edges = [i / bins for i in range(bins)] + [1.0]
        own = calibration_errors(reliability(chances, "q", "hit", edges, ["model", "label"]), ["model", "label"]).groupBy("model").agg(F.avg("ece").alias("ece"))
        table = table.join(F.broadcast(own), "model", "left")  # a row a model
    else:
        table = table.withColumn("ece", F.lit(None).cast("double"))
    board = leaderboard(table, ["balanced_accuracy"])
    learned = F.when(~F.col("model").isin(*baselines), F.col("place"))
    first = F.min(learned).over(Window.partitionBy(F.lit(1)))  # a row a model
    return board.withColumn("is_best_learned", F.coalesce((learned == first).cast("int"), F.lit(0)))


def save_best(table: DataFrame, candidates: dict[str, Callable[[], Pipeline]], df: DataFrame, path: str) -> str:
    """Fits the first candidate of a search's table on all rows, saves it, and gives its name."""
    name = table.head()["candidate"]
    candidates[name]().fit(df).write().overwrite().save(path)
    return name
