"""Features for classifiers, hooks for given models, expressions from trees, splits and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.operators.screen import bar_features, conform, last_bar_features


def labelled_last_bars(sums: DataFrame, labels: DataFrame, stage: int | None = None) -> DataFrame:
    """last_bar_features of each code, of its bars with a stage label only where `stage` is given, and `label`: the place of the code's class in the order of class names.

    labels has code and class, sums a column `stage` where one is asked for. Codes without a class leave.
    """
    rows = sums if stage is None else sums.where(F.col("stage") == stage)
    names = labels.select("class").distinct().withColumn("label", F.row_number().over(Window.orderBy("class")) - 1)  # one row for each class
    return last_bar_features(rows).join(labels.join(F.broadcast(names), "class").select("code", "label"), "code")


def extracted(bars: DataFrame, feature_function: Callable[[pd.DataFrame], dict], schema: T.StructType, key: str = "code", rows: int = 60) -> DataFrame:
    """What a function makes of each key's last `rows` bars, by time: one row of the schema beside the key; names that it doesn't give are null. The number of bars bounds a group."""
    recent = bars.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts")))).where(F.col("_r") <= rows).drop("_r")
    out = T.StructType([recent.schema[key], *schema.fields])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = feature_function(group.sort_values("ts"))
        return pd.DataFrame([{key: group[key].iloc[0], **{f: found.get(f) for f in schema.names}}])

    return recent.groupBy(key).applyInPandas(run, out)


def classified(rows: DataFrame, names: list[str], predict: Callable[[pd.DataFrame], pd.DataFrame], classes: int, keys: list[str]) -> DataFrame:
    """keys and probabilities (class1 .. classN) by a given model, a function from features in the order of `names` to a column for each class. Missing features are 0."""
    wanted = conform(rows.withColumn("_keys", F.struct(*keys)), names, "_keys")
    schema = T.StructType([T.StructField("_keys", wanted.schema["_keys"].dataType), T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = predict(batch[names]).to_numpy()
            yield pd.DataFrame({"_keys": batch["_keys"].tolist(), "probabilities": [{f"class{i + 1}": float(p) for i, p in enumerate(r[:classes])} for r in found]})

    # Struct cells of pandas are dictionaries, which the schema takes back.
    return wanted.mapInPandas(run, schema).select("_keys.*", "probabilities")


#: Added to every variance of a fitted model, so that features that never vary don't decide.
SMOOTH = 1e-6


def fitted(rows: DataFrame, names: list[str], label: str, *keys: str) -> dict[tuple, dict[int, tuple[float, np.ndarray, np.ndarray]]]:
    """A naive Bayes model with normal features for each value of the keys: of each class (0, 1) its share, means and variances.

    One aggregation fits all models; the driver gets a row for each model and class. Rows without a label or key don't count, missing features
    are 0, and where a class has no rows there is no model.
    """
    filled = rows.where(F.col(label).isin(0, 1)).select(*keys, label, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    told = filled.groupBy(*keys, label).agg(F.count("*").alias("_rows"), *[f(c).alias(f"_{k}_{c}") for c in names for k, f in (("m", F.avg), ("v", F.var_pop))])
    models: dict[tuple, dict] = {}
    for r in told.collect():
        values = [np.array([r[f"_{k}_{c}"] for c in names]) for k in "mv"]
        models.setdefault(tuple(r[k] for k in keys), {})[int(r[label])] = (r["_rows"], values[0], values[1] + SMOOTH)
    whole = {k: sum(c[0] for c in m.values()) for k, m in models.items()}
    return {k: {y: (n / whole[k], mean, var) for y, (n, mean, var) in m.items()} for k, m in models.items() if len(m) == 2 and None not in k}


def predicted(rows: DataFrame, names: list[str], models: dict[tuple, dict[int, tuple[float, np.ndarray, np.ndarray]]], *keys: str) -> DataFrame:
    """rows that have a model, with the probability of class 1 (`up`) and `prediction` (1 if it is above a half). Each worker sets the models up once."""
    names, order = list(names), sorted(models)
    if not order:
        return rows.where("false").withColumns({"up": F.lit(0.0), "prediction": F.lit(0)})

    def make():  # noqa: ANN202
        share, mean, var = (np.array([[models[k][y][i] for y in (0, 1)] for k in order]) for i in range(3))
        base = np.log(share) - 0.5 * np.log(2 * np.pi * var).sum(-1)

        def run(features: np.ndarray, which: np.ndarray) -> np.ndarray:
            own = which.astype(np.int64).ravel()
            score = base[own] - (np.square(features[:, None, :] - mean[own]) / (2 * var[own])).sum(-1)
            return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -700, 700)))

        return run

    score = predict_batch_udf(make, return_type=T.DoubleType(), batch_size=4096, input_tensor_shapes=[[len(names)], [1]])
    place = F.create_map(*[x for i, k in enumerate(order) for x in (F.to_json(F.array(*[F.lit(str(v)) for v in k])), F.lit(float(i)))])
    model = F.try_element_at(place, F.to_json(F.array(*[F.col(k).cast("string") for k in keys])))
    found = rows.withColumn("_model", model).where("_model is not null")
    cells = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])
    return found.withColumn("up", score(cells, F.array("_model"))).drop("_model").withColumn("prediction", (F.col("up") > 0.5).cast("int"))


def segment_rows(segments: DataFrame, sums: DataFrame, history: int = 50) -> DataFrame:
    """Every segment (code, stage, lo, hi, start, end, ..) beside the features of each of its bars, made of the bars of `history` calendar days before its start up to its end: ts, n and the features."""
    keys = ("code", "stage", "lo", "hi")
    wanted = segments.withColumns({"_code": F.col("code"), "code": F.concat_ws("|", *keys)})
    days = wanted.select("code", "_code", "start", F.explode(F.sequence(F.date_sub("start", history), F.col("end"))).alias("ts"))
    bars = sums.withColumnRenamed("code", "_code")
    group = days.join(bars, ["_code", "ts"])
    # As `code` a segment's key takes the windows of the features to its own bars.
    told = bar_features(group.drop("_code", "start")).join(group.select("code", "ts", "n", "start"), ["code", "ts"]).where(F.col("ts") >= F.col("start")).drop("start")
    clash = [c for c in told.columns if c in segments.columns and c != "code"]
    return wanted.join(told.drop(*clash), "code").drop("code").withColumnRenamed("_code", "code")


def by_duration(segments: DataFrame, predict: dict[tuple[str, str], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Segments with the probabilities of the model for their stage and duration type; each model maps rows to (code, stage, lo, hi, probabilities). Segments without a model have an empty map."""
    empty = F.create_map().cast("map<string,double>")
    found = None
    for (stage, kind), model in predict.items():
        part = model(segments.where((F.col("stage") == stage) & (F.col("duration_type") == kind))).select("code", "stage", "lo", "hi", "probabilities")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return segments.withColumn("probabilities", empty)
    return segments.join(found, ["code", "stage", "lo", "hi"], "left").withColumn("probabilities", F.coalesce("probabilities", empty))


def vote(predictions: DataFrame, *keys: str) -> DataFrame:
    """Of row predictions (0 or 1) and class probabilities: 'long' if more than half of a key's rows say 1, and the mean of each class."""
    parts = predictions.select(*keys, "prediction", F.explode_outer("probabilities").alias("class", "p"))
    means = parts.where("class is not null").groupBy(*keys, "class").agg(F.avg("p").alias("p")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("class", "p"))).alias("probabilities"))
    kinds = predictions.groupBy(*keys).agg(F.when(F.avg("prediction") > 0.5, "long").otherwise("short").alias("kind"))
    return kinds.join(means, list(keys), "left")


_TWO = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "max": F.greatest, "min": F.least, "div": lambda a, b: F.when(F.abs(b) > 0.001, a / b).otherwise(1.0)}
_ONE = {"neg": lambda a: -a, "sqrt": lambda a: F.sqrt(F.abs(a)), "log": lambda a: F.when(F.abs(a) > 0.001, F.log(F.abs(a))).otherwise(0.0), "abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan}
_SIGN = {"add": "+", "sub": "-", "mul": "*", "div": "/"}


def expression(tree: tuple | str | float) -> Column:
    """A Column of an expression tree: (function, argument, ...), a column's name or a number. Division by almost 0 gives 1, the logarithm of almost 0 gives 0, roots and logarithms take the size."""
    if isinstance(tree, str):
        return F.col(tree)
    if isinstance(tree, (int, float)):
        return F.lit(float(tree))
    name, *arguments = tree
    cells = [expression(a) for a in arguments]
    if name in ("max", "min"):
        return _TWO[name](*cells)
    return _TWO[name](*cells) if name in _TWO else _ONE[name](*cells)


def readable(tree: tuple | str | float) -> str:
    """The tree as text: sums, differences, products and quotients in brackets, other functions by name."""
    if not isinstance(tree, tuple):
        return str(tree)
    name, *arguments = tree
    texts = [readable(a) for a in arguments]
    if name in _SIGN:
        return f"({texts[0]} {_SIGN[name]} {texts[1]})"
    return f"-({texts[0]})" if name == "neg" else f"{name}({', '.join(texts)})"


def split(rows: DataFrame, *keys: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """rows with `part`, train or test, by a hash of the keys: each label's rows are split in about this share, without bringing them together, and a split repeats on any cluster."""
    place = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))), 1, 7), 16, 10).cast("long")
    return rows.withColumn("part", F.when(place < F.lit(int(share * 16**7)), "train").otherwise("test"))


def evaluate(rows: DataFrame, names: list[str], label: str = "label", trees: int = 100, seed: int = 42) -> tuple[float, list[tuple[str, float]]]:
    """Accuracy on rows whose part is test of a random forest fitted on the others, and the features by their importance, ties by name."""
    filled = rows.select(F.col(label).cast("double").alias("_label"), "part", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_x"), RandomForestClassifier(featuresCol="_x", labelCol="_label", numTrees=trees, seed=seed)]).fit(filled.where("part = 'train'"))
    told = model.transform(filled.where("part = 'test'")).agg(F.avg((F.col("prediction") == F.col("_label")).cast("double"))).first()[0]
    importance = model.stages[-1].featureImportances.toArray()
    return float(told or 0.0), sorted(zip(names, map(float, importance), strict=True), key=lambda x: (-x[1], x[0]))
