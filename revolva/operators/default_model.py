"""The default model: a logistic regression on card features.

The label is taken from the same statements as the features, so the model
describes the book and does not forecast it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revolva.config import DEFAULTS, RiskConfig
from revolva.functions import windows
from revolva.functions.numeric import fixed, ratio, rows
from revolva.operators import frames
from revolva.plans import regression, sampling, selection
from revolva.plans.portfolio import Portfolio
from revolva.sources import store

FEATURES = ["avg_util", "max_util", "avg_pay_ratio", "avg_dpd", "del_months", "avg_rev_bal"]
LABEL = "default_flag"
SCALED = [f"z_{name}" for name in FEATURES]
#: Scores of six decimals that are ordered at once.
SLICE = 1 << 16


def class_balance(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return frames.card_features(p, cfg).groupBy(LABEL).agg(rows().alias("cards")).orderBy(LABEL)


def split(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Card features with a stratified train/test label.

    The first share of each class is held out, by a seeded hash of the card's key. The
    cut is found by counting hashes, so a class may be of any size.
    """
    cards = frames.card_features(p, cfg).select("card_id", LABEL, *FEATURES)
    order = [F.upper(sampling.draw(cfg.seed, "card_id")), selection.whole("card_id")]
    drawn = selection.with_first_share(cards, order, cfg.test_share, "_held_out", F.col(LABEL))
    return drawn.withColumn("split", F.when(F.col("_held_out"), "test").otherwise("train")).drop("_held_out")


@dataclass(frozen=True)
class FittedModel:
    """Weights and scaling, and the stored cards of both splits."""

    cards: DataFrame
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    fitted: regression.LogisticFit

    @property
    def train(self) -> DataFrame:
        return self.cards.where(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.cards.where(F.col("split") == "test")

    def standardised(self, cards: DataFrame) -> DataFrame:
        """``cards`` with the scaled features; a feature without spread is zero."""
        z = {
            name: F.coalesce((F.col(c) - F.lit(m)) / F.nullif(F.lit(s), F.lit(0.0)), F.lit(0.0))
            for name, c, m, s in zip(SCALED, FEATURES, self.means, self.deviations)
        }
        return cards.withColumns(z)

    @property
    def scored(self) -> DataFrame:
        """The held-out cards with ``margin``, the linear predictor, and ``probability``."""
        return self.standardised(self.test).withColumns(
            {
                "margin": F.expr(regression.margin(self.fitted.weights, SCALED)),
                "probability": regression.probability(self.fitted.weights, SCALED),
            }
        )


def fit(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> FittedModel:
    """Scale the features on the training cards and fit the regression on them.

    The loss is summed over cards, and the penalty is one half of the squared weights. The
    cards are stored first, as every step of the fit reads them.
    """
    cards = store.kept(split(p, cfg), "default-model")
    train = cards.where(F.col("split") == "train")
    moments = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in FEATURES], *[F.stddev_samp(c).alias(f"s_{c}") for c in FEATURES]
    ).first()
    means = tuple(float(moments[f"m_{c}"] or 0) for c in FEATURES)
    deviations = tuple(float(moments[f"s_{c}"] or 0) for c in FEATURES)
    unfitted = FittedModel(cards, means, deviations, regression.LogisticFit((), (), 0.0, 0))
    if train.where(" OR ".join(f"{c} IS NULL" for c in FEATURES)).limit(1).count():
        raise ValueError("a card without balance or limit has no features")
    fitted = regression.newton(unfitted.standardised(train), SCALED, LABEL)
    return FittedModel(cards, means, deviations, fitted)


def scaled(m: FittedModel) -> DataFrame:
    """Standardised features of all cards, scaled by the training cards."""
    return m.standardised(m.cards).select("card_id", "split", *[fixed(c, 6).alias(c) for c in SCALED])


def coefficients(m: FittedModel) -> DataFrame:
    """Fitted weights, on the standardised features, and the intercept."""
    names = ["intercept", *FEATURES]
    return m.cards.sparkSession.createDataFrame(list(zip(names, m.fitted.weights)), "feature string, weight double")


def predictions(m: FittedModel) -> DataFrame:
    return m.scored.select(
        "card_id",
        F.col(LABEL).alias("label"),
        (F.col("probability") > 0.5).cast("int").alias("prediction"),
        "probability",
    )


def _steps(scores: DataFrame, score: Column) -> DataFrame:
    return scores.groupBy(score.alias("step")).agg(
        F.count_if(F.col("label") == 1).alias("hits"), F.count_if(F.col("label") == 0).alias("others")
    )


def area(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve of (label, score) at six decimals of the score, ties counting half.

    It is the chance that a positive row scores above a negative one. Scores are counted,
    then ordered within slices of ``SLICE`` values, so no task holds more than a slice.
    """
    steps = _steps(scores, F.rint(F.col("score") * 10**6).cast("bigint")).withColumn("slice", F.floor(F.col("step") / SLICE))
    slices = steps.groupBy("slice").agg(F.sum("others").alias("_n"))
    earlier = windows.before_now(windows.all_groups().orderBy("slice"))
    bases = slices.select("slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("base"))
    inside = windows.before_now(Window.partitionBy("slice").orderBy("step"))
    below = F.col("base") + F.coalesce(F.sum("others").over(inside), F.lit(0))
    return (
        steps.join(bases, "slice")
        .select("hits", "others", (F.col("hits").cast("decimal(38,0)") * (2 * below + F.col("others"))).alias("won"))
        .agg(F.sum("won").alias("won"), F.sum("hits").alias("hits"), F.sum("others").alias("others"))
        .select(fixed(ratio("won", 2.0 * F.col("hits").cast("double") * F.col("others")), 8).alias("roc_auc"))
    )


def auc(m: FittedModel) -> DataFrame:
    """Area under the ROC curve on the held-out cards, by the linear predictor."""
    return area(m.scored.select(F.col(LABEL).alias("label"), F.col("margin").alias("score")))


def confusion(m: FittedModel) -> DataFrame:
    """All four cells, empty ones with zero."""
    hit = lambda y, z: F.count_if((F.col("label") == y) & (F.col("prediction") == z))
    cells = [(y, z) for y in (0, 1) for z in (0, 1)]
    counts = predictions(m).agg(*[hit(y, z).alias(f"c{y}{z}") for y, z in cells])
    table = [
        F.struct(F.lit(y).alias("label"), F.lit(z).alias("prediction"), F.col(f"c{y}{z}").alias("cards"))
        for y, z in cells
    ]
    return counts.select(F.inline(F.array(*table)))


def report(m: FittedModel) -> DataFrame:
    """Precision, recall, F1 and support per class, and their averages."""
    n = lambda y, z: F.sum(F.when((F.col("label") == y) & (F.col("prediction") == z), F.col("cards")))
    cells = confusion(m).agg(*[n(y, z).alias(f"c{y}{z}") for y in (0, 1) for z in (0, 1)])

    def scores(y: int):
        right, wrong_in, wrong_out = f"c{y}{y}", f"c{1 - y}{y}", f"c{y}{1 - y}"
        support = F.col(right) + F.col(wrong_out)
        precision = F.coalesce(ratio(right, F.col(right) + F.col(wrong_in)), F.lit(0.0))
        recall = F.coalesce(ratio(right, support), F.lit(0.0))
        f1 = F.coalesce(ratio(2 * precision * recall, precision + recall), F.lit(0.0))
        return precision, recall, f1, support

    zero, one = scores(0), scores(1)
    everything = zero[3] + one[3]
    mean = lambda i: (zero[i] + one[i]) / 2
    weighted = lambda i: ratio(zero[i] * zero[3] + one[i] * one[3], everything)
    accuracy = ratio(F.col("c00") + F.col("c11"), everything)

    def line(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1_score"),
            support.alias("support"),
        )

    lines = [
        line("0", *zero),
        line("1", *one),
        line("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), accuracy, everything),
        line("macro avg", mean(0), mean(1), mean(2), everything),
        line("weighted avg", weighted(0), weighted(1), weighted(2), everything),
    ]
    return cells.select(F.inline(F.array(*lines)))


def roc_curve(scores: DataFrame) -> DataFrame:
    """ROC points of (label, score): one for each threshold of four decimals, and the origin.

    At most 10,001 thresholds at any number of rows.
    """
    steps = scores.groupBy(F.rint(F.col("score") * 10_000).cast("int").alias("step")).agg(
        F.count_if(F.col("label") == 1).alias("hits"), F.count_if(F.col("label") == 0).alias("alarms")
    )
    falling = windows.all_groups().orderBy(F.desc("step"))
    share = lambda c: ratio(F.sum(c).over(windows.up_to_now(falling)), F.sum(c).over(windows.all_groups()))
    points = steps.select(
        (F.col("step") / 10_000).alias("threshold"), share("alarms").alias("fpr"), share("hits").alias("tpr")
    )
    origin = scores.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(points).orderBy("fpr", "tpr")


def roc(m: FittedModel) -> DataFrame:
    """Points of the ROC curve on the held-out cards."""
    return roc_curve(predictions(m).withColumnRenamed("probability", "score"))


def score_roc(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """ROC curve of the behavioural score against the default flag."""
    return roc_curve(frames.pd_scores(p, cfg).select(F.col(LABEL).alias("label"), F.col("pd_score").alias("score")))


def score_auc(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Area under that curve: the chance that a defaulted card scores above another, ties count half."""
    steps = frames.pd_scores(p, cfg).groupBy("pd_score").agg(
        F.count_if(F.col(LABEL) == 1).alias("hits"), F.count_if(F.col(LABEL) == 0).alias("others")
    )
    # Scores have four decimals: at most 10,001 groups.
    below = F.coalesce(F.sum("others").over(windows.before_now(windows.all_groups().orderBy("pd_score"))), F.lit(0))
    return (
        steps.select("hits", "others", (F.col("hits") * (2 * below + F.col("others"))).alias("won"))
        .agg(F.sum("won").alias("won"), F.sum("hits").alias("hits"), F.sum("others").alias("others"))
        .select(fixed(ratio("won", 2 * F.col("hits") * F.col("others")), 8).alias("roc_auc"))
    )
