"""Learners of pyspark.ml behind one interface, and importance by permuting a column."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.operators.ranking import running_totals


def prepare(df: DataFrame, columns: list[str], label: str, stride: int = 1) -> DataFrame:
    """Doubles, flags of what is missing, and weights that undo a negative sampling of one in stride."""
    df = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in columns})
    return df.withColumns({c: F.col(c).cast("double") for c in columns}).withColumn("weight", F.when(F.col(label) == 1, 1.0).otherwise(float(stride)))


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The most frequent value of each column as text, ties to the smaller; empty text where all are null."""
    out = {}
    for c in columns:
        top = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").first()
        out[c] = top["v"] if top else ""
    return out


def _categorical(df: DataFrame, categories: list[str]) -> list:
    """Stages that fill nulls by the mode and give one column a value; a value not seen in fitting has all of them 0."""
    text = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    filled = ", ".join(f"coalesce(cast(`{c}` as string), {text(v)}) as `{c}_filled`" for c, v in modes(df, categories).items())
    index = StringIndexer(inputCols=[f"{c}_filled" for c in categories], outputCols=[f"{c}_index" for c in categories], handleInvalid="keep", stringOrderType="alphabetAsc")
    # "keep" gives the unseen an index of their own, the last, which the encoder drops
    hot = OneHotEncoder(inputCols=[f"{c}_index" for c in categories], outputCols=[f"{c}_hot" for c in categories], dropLast=True)
    return [SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"), index, hot]


def fit(df: DataFrame, columns: list[str], label: str, kind: str = "logistic", categories: list[str] | None = None) -> PipelineModel:
    inputs = [*[f"{c}_filled" for c in columns], *[f"{c}_missing" for c in columns]]
    if categories:
        inputs += [f"{c}_hot" for c in categories]
    stages = [*(_categorical(df, categories) if categories else []), Imputer(strategy="median", inputCols=columns, outputCols=[f"{c}_filled" for c in columns]), VectorAssembler(inputCols=inputs, outputCol="raw")]
    if kind == "logistic":
        stages += [StandardScaler(inputCol="raw", outputCol="features"), LogisticRegression(labelCol=label, weightCol="weight", regParam=0.01)]
    else:
        stages += [GBTClassifier(labelCol=label, featuresCol="raw", weightCol="weight", maxIter=10, maxDepth=3, seed=7)]
    return Pipeline(stages=stages).fit(df)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def permuted(df: DataFrame, column: str, key: str, salt: str) -> DataFrame:
    """df with the column dealt anew: rows in the order of one salted hash of the key take the values in the order of another.

    The same each time; both orders are numbered range by range (running_totals). The key is unique.
    """
    number = lambda rows, word: running_totals(rows.withColumn("_h", F.xxhash64(F.lit(salt + word), F.col(key))), "_h", {"_n": F.lit(1)}, [key]).drop("_h")
    values = number(df.select(key, F.col(column).alias("_v")), "values").select("_n", "_v")
    return number(df.drop(column), "rows").join(values, "_n").withColumnRenamed("_v", column).drop("_n")


def gain_importance(model: PipelineModel, columns: list[str], prefix: str = "") -> list[tuple[str, float]]:
    """(input, share of the gain) of a boosted model of fit(), largest first, for inputs that begin with prefix."""
    names = [*columns, *[f"{c}_missing" for c in columns]]
    gains = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(((n, g) for n, g in zip(names, gains, strict=True) if n.startswith(prefix)), key=lambda x: (-x[1], x[0]))


def surrogate(predicted: DataFrame, columns: list[str], threshold: float, depth: int = 4, emphasis: float = 10.0) -> str:
    """The rules of a shallow tree that imitates predict()'s scores, in which rows at or above threshold weigh more."""
    inputs = [*[f"{c}_filled" for c in columns], *[f"{c}_missing" for c in columns]]
    rows = predicted.select("raw", "score").withColumn("emphasis", F.when(F.col("score") >= threshold, emphasis).otherwise(1.0))
    tree = DecisionTreeRegressor(featuresCol="raw", labelCol="score", weightCol="emphasis", maxDepth=depth, seed=7).fit(rows)
    text = tree.toDebugString
    for i in range(len(inputs) - 1, -1, -1):
        text = text.replace(f"feature {i} ", f"{inputs[i]} ")
    return text


def harder(df: DataFrame, first: PipelineModel, label: str, threshold: float, factor: float) -> DataFrame:
    """df in which negatives that the first model scores at or above threshold weigh factor times as much, to fit again."""
    hard = (F.col(label) == 0) & (F.col("score") >= threshold)
    return predict(first, df).withColumn("weight", F.when(hard, F.col("weight") * factor).otherwise(F.col("weight"))).select(*df.columns)


def by_history(df: DataFrame, missing: str, known: PipelineModel, cold: PipelineModel) -> DataFrame:
    """Scores of one model where a history is known and of another where it is missing; a null flag counts as known."""
    cold_row = F.coalesce(F.col(missing).cast("boolean"), F.lit(False))
    keep = [*df.columns, "score"]
    return predict(known, df.where(~cold_row)).select(*keep).unionByName(predict(cold, df.where(cold_row)).select(*keep))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
