"""Features, training sets, classifiers and their evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.ml.evaluation import Evaluator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions import fields
from lociq.operators import boosting, kernel, reports
from lociq.operators.ordering import numbered
from lociq.scratch import stored

Model = PipelineModel | CrossValidatorModel | boosting.Boosted | kernel.KernelModel
#: The estimators that are written here, and the settings that a search tries.
OWN = {"boosted": (boosting.fit, boosting.Boosted, [{"rate": r, "depth": d} for r in (0.1, 0.3) for d in (3, 5)]), "kernel": (kernel.fit, kernel.KernelModel, [{"cost": c, "gamma": g} for c in (0.1, 1.0, 10.0) for g in (None, 0.1)])}

_HASH_BITS = 14  # ranges of the hash by which a sample is drawn

CLASSES = ("heterozygous", "homozygous", "no_variance")
#: Filled from INFO, and from the sample; the others are in the vector but always 0.
INFO_FEATURES = ("DP", "VDB", "RPB", "MQB", "BQB", "SGB")
SAMPLE_FEATURES = ("BAF", "GQ")
EMPTY_FEATURES = ("QS", "MQSB", "MQ0F")
I16_FEATURES = tuple(f"f_i16_{i}" for i in range(16))


def feature(key: str) -> str:
    """Column of a named field's feature."""
    return f"f_{key.lower()}"


FEATURES = ("f_pos", *map(feature, (*INFO_FEATURES, *SAMPLE_FEATURES, *EMPTY_FEATURES)), *I16_FEATURES)


def features(variants: DataFrame) -> DataFrame:
    """Adds the feature columns to variants (info, format, sample as text). An absent named field is 0.0; the I16
    columns are null unless all sixteen are there."""
    zero = F.lit(0.0)
    first = lambda c: F.coalesce(F.get(F.split(c, ","), 0).try_cast("double"), zero)
    sample = lambda k: first(fields.format_value(F.col("format"), F.col("sample"), k))
    counts = F.transform(F.split(fields.info_value(F.col("info"), "I16"), ","), lambda x: x.try_cast("double"))
    whole = (F.size(counts) >= 16) & ~F.exists(counts, lambda x: x.isNull())
    named = {"f_pos": F.col("pos").cast("double")} | {feature(k): first(fields.info_value(F.col("info"), k)) for k in INFO_FEATURES}
    named |= {feature(k): sample(k) for k in SAMPLE_FEATURES} | {feature(k): zero for k in EMPTY_FEATURES}
    return variants.withColumns(named | {c: F.when(whole, F.get(counts, i)) for i, c in enumerate(I16_FEATURES)})


def filled_with_zero(rows: DataFrame) -> DataFrame:
    return rows.na.fill(0.0, list(FEATURES))


def filled_with_mean(rows: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Missing values become the column's mean, a column without any value becomes 0.0. The means are one row."""
    means = rows.agg(*[F.avg(c).alias(f"__{c}") for c in names])
    joined = rows.join(F.broadcast(means))
    return joined.withColumns({c: F.coalesce(c, f"__{c}", F.lit(0.0)) for c in names}).drop(*[f"__{c}" for c in names])


def scaled(rows: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Each feature minus its mean, over its population standard deviation; a constant feature becomes 0."""
    moments = rows.agg(*[f(c).alias(f"__{k}_{c}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = rows.join(F.broadcast(moments))
    value = lambda c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)
    return joined.withColumns({c: value(c) for c in names}).drop(*[f"__{k}_{c}" for c in names for k in "ms"])


def training_class(orig_gt: Column, new_gt: Column) -> Column:
    """homozygous: now 1/1 from 1/1 or 0/1. heterozygous: now 0/1 from 0/1 or 1/1. no_variance: now 0/0 from either."""
    variant = orig_gt.isin("0/1", "1/1")
    return F.when(variant & (new_gt == "1/1"), "homozygous").when(variant & (new_gt == "0/1"), "heterozygous").when(variant & (new_gt == "0/0"), "no_variance")


def training_sets(transitions: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Labelled variants: by their transition, and sequencing errors (chrom, pos, ref, alt) as no_variance."""
    rows = transitions.withColumn("label", training_class(F.col("orig_gt"), F.col("new_gt"))).filter("label IS NOT NULL").select("chrom", "pos", "ref", "alt", "label")
    return rows if errors is None else rows.unionByName(errors.select("chrom", "pos", "ref", "alt", F.lit("no_variance").alias("label")))


def quotas(sizes: dict[str, int], most: int) -> dict[str, int]:
    """How many rows of each class to take so that at most ``most`` are: in proportion, the rest to no_variance."""
    total = sum(sizes.values())
    if total <= most:
        return dict(sizes)
    taken = {c: most * sizes.get(c, 0) // total for c in CLASSES[:2]}
    return taken | {"no_variance": min(sizes.get("no_variance", 0), most - sum(taken.values()))}


def sampled(rows: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """A training sample of bounded size, the same in every run: the lowest hashes of each class.

    One aggregation counts the rows of each class in 2 ** _HASH_BITS ranges of the hash; those counts, which any tables' can be added
    to, say in which range a class's last row is. All rows of the ranges before it are taken as they are, and only those of that
    one range are put in order: no class is sorted.
    """
    keyed = stored(rows.withColumn("__h", F.xxhash64(F.lit(seed), "chrom", "pos", "ref", "alt")), "sample")
    at = F.shiftright("__h", 64 - _HASH_BITS)
    counts: dict[str, dict[int, int]] = {}
    for r in keyed.groupBy("label", at.alias("at")).agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["label"], {})[r["at"]] = r["n"]
    whole, edges = F.lit(False), []
    for label, n in quotas({c: sum(x.values()) for c, x in counts.items()}, most).items():
        own = F.col("label") == label
        for place in sorted(counts.get(label, {})):
            if n < counts[label][place]:
                edges.append(keyed.filter(own & (at == place)).orderBy("__h", "chrom", "pos", "ref", "alt").limit(n))
                whole = whole | (own & (at < place))
                break
            n -= counts[label][place]
        else:
            whole = whole | own
    return reduce(DataFrame.unionByName, edges, keyed.filter(whole)).drop("__h")


def split(rows: DataFrame, test_share: float = 0.2) -> DataFrame:
    """Adds ``is_test``, true for that share of every class, chosen by the key's hash (md5, so any engine can repeat it)."""
    key = F.md5(F.concat_ws("_", "chrom", F.col("pos").cast("string"), "ref", "alt"))
    ranked = numbered(rows.withColumn("__key", key), ["__key", "chrom", "pos"], ["label"])
    return ranked.withColumn("is_test", F.col("place") < F.ceil(F.col("among") * test_share)).select(*rows.columns, "is_test")


def explained_variance(rows: DataFrame, names: tuple[str, ...], threshold: float = 0.95) -> tuple[list[float], int]:
    """Shares of variance of the principal components, and how many reach the threshold together."""
    vectors = VectorAssembler(inputCols=list(names), outputCol="v").transform(rows)
    shares = PCA(k=len(names), inputCol="v", outputCol="p").fit(vectors).explainedVariance.toArray().tolist()
    total = 0.0
    for i, share in enumerate(shares, 1):
        total += share
        if total >= threshold - 1e-12:
            return shares, i
    return shares, len(shares)


class VariantF1(Evaluator):
    """Scores a model by the mean F1 of the variant classes, with the labels' numbers as they are encoded."""

    def _evaluate(self, dataset: DataFrame) -> float:
        name = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("prediction") + 1).cast("int"))
        return reports.variant_f1(dataset.select("label", name.alias("predicted"))).first()[0]


def _estimator(kind: str, n_inputs: int, seed: int):
    if kind == "forest":
        return RandomForestClassifier(featuresCol="v", labelCol="class", numTrees=100, seed=seed)
    if kind == "perceptron":
        return MultilayerPerceptronClassifier(featuresCol="v", labelCol="class", layers=[n_inputs, 64, 32, 3], seed=seed, maxIter=100)
    raise ValueError(f"no such model: {kind}")


def search(rows: DataFrame, kind: str, names: tuple[str, ...] = FEATURES, grid: list[dict] | None = None, folds: int = 5, seed: int = 42) -> dict:
    """The settings of an own estimator with the best mean variant F1 over folds, which the key's hash deals out; of equals the first."""
    fit, _, default = OWN[kind]
    fold = F.pmod(F.xxhash64(F.lit(seed), "chrom", "pos", "ref", "alt"), F.lit(folds))
    dealt = stored(rows.select("chrom", "pos", "ref", "alt", "label", *names).withColumn("__fold", fold), "folds")

    def score(setting: dict) -> float:
        found = []
        for i in range(folds):
            model = fit(dealt.filter(F.col("__fold") != i), list(names), "label", list(CLASSES), **setting)
            found.append(reports.variant_f1(classified(model, dealt.filter(F.col("__fold") == i))).first()[0])
        return sum(found) / folds

    return max(grid or default, key=score)


def train(rows: DataFrame, kind: str = "forest", names: tuple[str, ...] = FEATURES, components: int | None = None, grid: bool = False, seed: int = 42, **settings) -> Model:
    """Fit a classifier on labelled feature rows: ``forest``, ``perceptron``, ``boosted`` trees or ``kernel`` (a Gaussian one). The first two
    optionally on principal components, the last two with ``settings`` of their own; with ``grid`` chosen by 5-fold search."""
    if kind in OWN:
        best = search(rows, kind, names, seed=seed) if grid else {}
        return OWN[kind][0](rows, list(names), "label", list(CLASSES), **(best | settings))
    code = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("label")) - 1
    stages = [VectorAssembler(inputCols=list(names), outputCol="inputs" if components else "v")]
    if components:
        stages.append(PCA(k=components, inputCol="inputs", outputCol="v"))
    model = _estimator(kind, components or len(names), seed)
    pipeline = Pipeline(stages=[*stages, model])
    labelled = rows.withColumn("class", code.cast("double"))
    if not grid:
        return pipeline.fit(labelled)
    builder = ParamGridBuilder()
    if kind == "forest":
        builder = builder.addGrid(model.maxDepth, [5, 10]).addGrid(model.numTrees, [50, 100])
    else:
        builder = builder.addGrid(model.maxIter, [50, 100])
    return CrossValidator(estimator=pipeline, estimatorParamMaps=builder.build(), evaluator=VariantF1(), numFolds=5, seed=seed).fit(labelled)


def classified(model: Model, rows: DataFrame) -> DataFrame:
    """Adds predicted (the class's name), p_het, p_hom and p_novar, each named for its own class."""
    if isinstance(model, (boosting.Boosted, kernel.KernelModel)):
        out = rows.withColumn("__p", model.probability(rows))
        out = out.withColumn("prediction", F.array_position("__p", F.array_max("__p")) - 1)
    else:
        out = model.transform(rows).withColumn("__p", vector_to_array("probability"))
    named = {p: F.get("__p", i) for i, p in enumerate(("p_het", "p_hom", "p_novar"))}
    name = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("prediction") + 1).cast("int"))
    return out.withColumns({"predicted": name, **named}).select(*rows.columns, "predicted", *named)


def save(model: Model, path: str) -> None:
    """Keep a fitted model, of a search the best one, for other sections."""
    if isinstance(model, (boosting.Boosted, kernel.KernelModel)):
        model.save(SparkSession.getActiveSession(), path)
    else:
        (model.bestModel if isinstance(model, CrossValidatorModel) else model).write().overwrite().save(path)


def load(path: str, kind: str = "forest") -> Model:
    return OWN[kind][1].load(SparkSession.getActiveSession(), path) if kind in OWN else PipelineModel.load(path)


def save_bundle(model: Model, tested: DataFrame, path: str) -> None:
    """Keep a model with what it reached: beside it the confusion table and the report of ``tested`` (label, predicted), and its accuracy
    and variant F1."""
    save(model, f"{path}/model")
    table = stored(reports.confusion(tested), "confusion")
    table.write.mode("overwrite").parquet(f"{path}/confusion")
    reports.class_report(table).write.mode("overwrite").parquet(f"{path}/report")
    reports.accuracy(table).join(F.broadcast(reports.variant_f1(tested))).write.mode("overwrite").parquet(f"{path}/scores")  # a row each


def load_bundle(spark: SparkSession, path: str, kind: str = "forest") -> tuple[Model, dict[str, DataFrame]]:
    return load(f"{path}/model", kind), {t: spark.read.parquet(f"{path}/{t}") for t in ("confusion", "report", "scores")}


def tagged(rows: DataFrame, model: str) -> DataFrame:
    """INFO with the class and its probabilities (four decimals) appended."""
    info = fields.with_tag(F.col("info"), f"{model}_CLASS", F.col("predicted"))
    for tag, column in (("HOMO", "p_hom"), ("HETERO", "p_het"), ("NOVAR", "p_novar")):
        info = fields.with_tag(info, f"{model}_{tag}", F.format_string("%.4f", column))
    return rows.withColumn("info", info)


def confident(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows whose predicted class has at least that probability."""
    p = F.when(F.col("predicted") == "heterozygous", F.col("p_het")).when(F.col("predicted") == "homozygous", F.col("p_hom")).otherwise(F.col("p_novar"))
    return rows.filter(p >= threshold)
