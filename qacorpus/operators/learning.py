"""Term weights and learning jobs on Spark ML (FEA4, ML1-ML5)."""

from __future__ import annotations

import time
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StopWordsRemover, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.classify import confidence, confidence_level
from ..functions.common import let
from ..session import write_out


def tfidf(df: DataFrame, id_column: str, text: str, max_features: int = 1000, stop_words: list[str] | None = None) -> DataFrame:
    """FEA4: (id, term, weight) for 1- and 2-grams, smooth idf ln((1+n)/(1+df))+1, L2-normalised.

    The vocabulary is counted first (map-side combined) and has at most ``max_features`` rows, so it is
    broadcast and only vocabulary terms are ever shuffled by document.
    """
    stop = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    kept = F.filter(tokens, lambda w: ~w.isin(*stop)) if stop else tokens
    grams = let(
        kept,
        lambda w: F.concat(
            w, F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
        ),
    )
    terms = df.select(id_column, F.explode(grams).alias("term"))
    vocabulary = (
        terms.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "term").limit(max_features).select("term")
    )
    # read twice, for the terms' documents and for the weights
    tf = write_out(terms.join(F.broadcast(vocabulary), "term").groupBy(id_column, "term").agg(F.count(F.lit(1)).alias("tf")), "tf")
    docs = df.agg(F.count(F.lit(1))).scalar()
    freq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # <= max_features rows
    weighted = tf.join(F.broadcast(freq), "term").withColumn(
        "w", F.col("tf") * (F.log((docs + 1) / (F.col("df") + 1)) + 1)
    )
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(id_column)))
    return weighted.select(id_column, "term", (F.col("w") / norm).alias("weight"))


def classifier_pipeline(estimator: str = "logistic", text: str = "question", label: str = "label", features: int = 1 << 14) -> Pipeline:
    """ML1: tokens, stop words, hashed term counts, idf, classifier, label names."""
    index = StringIndexer(inputCol=label, outputCol="label_id", stringOrderType="alphabetAsc", handleInvalid="skip")
    stages = [
        index,
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}\p{N}_]+"),
        StopWordsRemover(inputCol="_tokens", outputCol="_words"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="features"),
    ]
    if estimator == "logistic":
        stages.append(LogisticRegression(labelCol="label_id", maxIter=20, regParam=0.01))
    elif estimator == "bayes":
        stages.append(NaiveBayes(labelCol="label_id"))
    else:
        raise ValueError(estimator)
    return Pipeline(stages=stages)


def predict(model, df: DataFrame) -> DataFrame:
    """Predictions with label names."""
    labels = model.stages[0].labels
    return IndexToString(inputCol="prediction", outputCol="predicted", labels=labels).transform(model.transform(df))


def fit_features(train: DataFrame, text: str = "question", label: str = "label") -> tuple[list, DataFrame]:
    """The fitted stages before the classifier, and the training rows as vectors.

    Texts are tokenised once: their counts are written, and idf and classifier read those.
    """
    index, *count, idf, _ = classifier_pipeline(text=text, label=label).getStages()
    front = [index.fit(train), *count]
    counts = write_out(PipelineModel(front).transform(train).select("label_id", "_tf"), "counts")
    weigh = idf.fit(counts)
    return [*front, weigh], weigh.transform(counts)


def train_text_classifier(train: DataFrame, test: DataFrame, estimator: str = "logistic", text: str = "question", label: str = "label"):
    """ML1: fitted model and test predictions."""
    classifier = classifier_pipeline(estimator, text, label).getStages()[-1]
    stages, vectors = fit_features(train, text, label)
    model = PipelineModel([*stages, classifier.fit(vectors)])
    return model, predict(model, test)


def compare_models(train: DataFrame, val: DataFrame, text: str = "question", label: str = "label",
                   estimators=("logistic", "bayes")) -> DataFrame:
    """ML2: one result row per estimator in the layout that the leaderboard reads.

    All estimators read the same vectors, which are made with the first one.
    """
    rows, made = [], None
    for i, name in enumerate(estimators):
        started = time.time()
        try:
            classifier = classifier_pipeline(name, text, label).getStages()[-1]
            if made is None:
                stages, vectors = fit_features(train, text, label)
                held_out = write_out(PipelineModel(stages).transform(val).select(F.col(label).alias("_label"), "features"), "vectors")
                made = stages[0].labels, vectors, held_out
            model = classifier.fit(made[1])
            scored = IndexToString(inputCol="prediction", outputCol="predicted", labels=made[0]).transform(model.transform(made[2]))
            accuracy = scored.agg(F.avg((F.col("predicted") == F.col("_label")).cast("double"))).first()[0]
            size = model.numFeatures * model.numClasses
            rows.append((i, name, "classifier", float(size), accuracy, time.time() - started, "success", None))
        except Exception as err:  # a failing model is a result row, not a failed comparison
            rows.append((i, name, "classifier", None, None, time.time() - started, "failed", str(err)[:200]))
    schema = (
        "ord int, model_key string, model_type string, parameter_count double, accuracy double, "
        "fit_seconds double, status string, error string"
    )
    return train.sparkSession.createDataFrame(rows, schema)


def tune(train: DataFrame, text: str = "question", label: str = "label", reg=(0.001, 0.01, 0.1), elastic=(0.0, 0.5),
         parallelism: int = 2, seed: int = 42) -> DataFrame:
    """ML3: grid search minimising log loss on a held-out part; one row per trial.

    As Spark's ``TrainValidationSplit``, but the stages before the classifier are fitted once for all trials, not once for each, and the
    best trial, whose model nobody asks for, is not fitted again on all rows.
    """
    lr = classifier_pipeline("logistic", text, label).getStages()[-1]
    grid = ParamGridBuilder().addGrid(lr.regParam, list(reg)).addGrid(lr.elasticNetParam, list(elastic)).build()
    metric = MulticlassClassificationEvaluator(labelCol="label_id", metricName="logLoss")
    dealt = write_out(train.withColumn("_rand", F.rand(seed)).select(text, label, "_rand"), "dealt")
    stages, vectors = fit_features(dealt.where("_rand < 0.8"), text, label)
    held_out = write_out(PipelineModel(stages).transform(dealt.where("_rand >= 0.8")).select("label_id", "features"), "vectors")

    def trial(g) -> float:
        return metric.evaluate(lr.fit(vectors, g).transform(held_out))

    with ThreadPool(max(1, min(parallelism, len(grid)))) as pool:
        losses = pool.map(inheritable_thread_target(train.sparkSession)(trial), grid)
    rows = [
        (i, float(g[lr.regParam]), float(g[lr.elasticNetParam]), float(v), "COMPLETE") for i, (g, v) in enumerate(zip(grid, losses))
    ]
    return train.sparkSession.createDataFrame(rows, "trial int, reg double, elastic double, value double, state string")


def top_k_predictions(scored: DataFrame, labels: list[str], id_column: str, k: int = 5) -> DataFrame:
    """ML4: the k most probable labels per row with confidence and level; no shuffle, arrays of label size."""
    entries = F.transform(
        vector_to_array("probability"), lambda p, i: F.struct((-p).alias("np"), i.alias("i"))
    )
    best = F.slice(F.array_sort(entries), 1, k)
    names = F.array(*[F.lit(x) for x in labels])
    out = scored.select(id_column, F.posexplode(best).alias("pos", "e"))
    conf = confidence(F.log(F.greatest(-F.col("e.np"), F.lit(1e-300))))
    return out.select(
        id_column, (F.col("pos") + 1).alias("rank"), F.get(names, F.col("e.i")).alias("label"), conf.alias("confidence"),
        confidence_level(conf).alias("level"),
    )


def early_stopping(history: DataFrame, run: str = "run_id", epoch: str = "epoch", accuracy: str = "val_accuracy", patience: int = 3) -> DataFrame:
    """ML5: per run: best epoch, its accuracy, the epoch where training stops (null: runs to the end).

    An epoch improves when it beats every earlier one.  Training stops after ``patience`` epochs in a row
    without improvement; later epochs are ignored.  Groups are the epochs of one run.
    """
    before = W.partitionBy(run).orderBy(epoch).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(run).orderBy(epoch).rowsBetween(W.unboundedPreceding, 0)
    best_before = F.coalesce(F.max(accuracy).over(before), F.lit(0.0))
    h = history.withColumn("_better", F.col(accuracy) > best_before)
    position = F.row_number().over(W.partitionBy(run).orderBy(epoch))
    h = h.withColumn("_i", position).withColumn("_last", F.coalesce(F.max(F.when(F.col("_better"), F.col("_i"))).over(upto), F.lit(0)))
    h = h.withColumn("_stop", (F.col("_i") - F.col("_last")) >= patience)
    h = h.withColumn("_done", F.coalesce(F.max(F.col("_stop").cast("int")).over(before), F.lit(0)))
    live = h.where(F.col("_done") == 0)
    return live.groupBy(run).agg(
        F.max_by(F.col(epoch), F.when(F.col("_better"), F.col("_i"))).alias("best_epoch"),
        F.max_by(F.col(accuracy), F.when(F.col("_better"), F.col("_i"))).alias("best_accuracy"),
        F.min(F.when(F.col("_stop"), F.col(epoch))).alias("stopped_at"),
    )
