"""Models that are fitted here: pipelines of hashed words and a linear classifier, and naive Bayes as a table of words, fitted on labelled rows, saved, read again, and applied in the JVM.

A fitted pipeline stands among the models under evaluation as any other (models.predicted), and is what scores the acceptability of sentences before and after correction.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IndexToString, NGram, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import settled
from . import metrics

#: Hashed features of each length of n-grams, and labels that a classifier may have.
HASHED, LABELS = 1 << 15, 100
#: What the pipeline's columns are named.
TEXT, WORDS, LABEL, SAID = "__text", "__words", "__label", "__said"
_TOKENS = f"SELECT *, transform(regexp_extract_all(coalesce({TEXT}, ''), \"{T.TOKEN}\", 0), w -> lower(w)) AS {WORDS} FROM __THIS__"


def hashed_ngrams(most: int = 2) -> list:
    """Stages that count words and n-grams by a hash: no vocabulary, so that nothing grows with the corpus."""
    stages, names = [], []
    for n in range(1, most + 1):
        runs, name = (WORDS if n == 1 else f"__grams{n}"), f"__hashed{n}"
        stages += [*([NGram(n=n, inputCol=WORDS, outputCol=runs)] if n > 1 else []), HashingTF(inputCol=runs, outputCol=name, numFeatures=HASHED)]
        names.append(name)
    return [*stages, VectorAssembler(inputCols=names, outputCol="__features")]


@dataclass(frozen=True)
class WordBayes:
    """Multinomial naive Bayes as a table: words (word, weights), the logarithms of each label's shares of the word, and each label's logarithm of its share of texts. The vocabulary, of all words that enough texts have, never comes to the driver."""

    labels: list[str]
    priors: list[float]
    words: DataFrame

    def save(self, path: str) -> None:
        spark = self.words.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self.words.write.parquet(f"{path}/words")
        spark.createDataFrame([(self.labels, self.priors)], _BAYES_META).coalesce(1).write.parquet(f"{path}/bayes")

    def scored(self, rows: DataFrame, text: Column, into: str) -> DataFrame:
        """Adds an array of the labels' scores. A text is scored once, however many rows have it."""
        keyed = rows.withColumn(TEXT, F.coalesce(text.cast("string"), F.lit(""))).withColumn("__key", F.unhex(F.sha1(F.col(TEXT).cast("binary"))))
        texts = keyed.select("__key", TEXT).dropDuplicates(["__key"])
        counts = texts.select("__key", F.explode(T.tokens(F.col(TEXT))).alias("word")).groupBy("__key", "word").agg(F.count("*").alias("n"))
        sums = [F.sum(F.col("n") * F.col("weights")[k]).alias(f"__s{k}") for k in range(len(self.labels))]
        found = counts.join(self.words, "word").groupBy("__key").agg(*sums)
        score = F.array(*(F.coalesce(f"__s{k}", F.lit(0.0)) + F.lit(p) for k, p in enumerate(self.priors)))
        return keyed.join(found, "__key", "left").select(*rows.columns, score.alias(into))


_BAYES_META = "labels array<string>, priors array<double>"


def _bayes(known: DataFrame, labels: list[str], least_rows: int = 2) -> WordBayes:
    """Fitted on (TEXT, LABEL): words that so many texts have at least, each count one larger than it is."""
    words = known.select(LABEL, T.tokens(F.col(TEXT)).alias("w"))
    both = F.concat(F.transform("w", lambda w: F.struct(w.alias("word"), F.lit(False).alias("once"))), F.transform(F.array_distinct("w"), lambda w: F.struct(w.alias("word"), F.lit(True).alias("once"))))
    each = range(len(labels))
    counts = words.select(LABEL, F.inline(both)).groupBy("word").agg(F.count_if("once").alias("rows"), *(F.count_if(~F.col("once") & (F.col(LABEL) == k)).alias(f"c{k}") for k in each))
    counts = settled(counts.where(F.col("rows") >= least_rows).drop("rows"), "words")
    sizes = counts.agg(F.count("*").alias("size"), *(F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"c{k}") for k in each)).first()  # one row
    texts = {int(r[LABEL]): r["count"] for r in known.groupBy(LABEL).count().collect()}  # a row a label
    priors = [math.log(texts.get(k, 0) + 1) - math.log(sum(texts.values()) + len(labels)) for k in each]
    weights = F.array(*(F.ln(F.col(f"c{k}") + 1.0) - F.lit(math.log(sizes[f"c{k}"] + sizes["size"]) if sizes["size"] else 0.0) for k in each))
    return WordBayes(labels, priors, counts.select("word", weights.alias("weights")))


def fit(rows: DataFrame, text: str, label: str, kind: str = "logistic") -> PipelineModel | WordBayes:
    """A classifier of texts: logistic (hashed words and pairs of words) or bayes (multinomial, counted words). Rows without a label or text are left out; ValueError if there are fewer than two labels, or too many."""
    known = rows.select(F.col(text).cast("string").alias(TEXT), F.col(label).cast("string").alias("__y")).where(F.col("__y").isNotNull() & ~T.blank(F.col(TEXT)))
    labels = sorted(r["__y"] for r in known.select("__y").distinct().limit(LABELS + 1).collect())
    if not 2 <= len(labels) <= LABELS:
        raise ValueError(f"a classifier needs 2 to {LABELS} labels, not {len(labels)}")
    known = known.select(TEXT, (F.array_position(F.array(*map(F.lit, labels)), F.col("__y")) - 1).cast("double").alias(LABEL))
    if kind == "bayes":
        return _bayes(known, labels)
    if kind != "logistic":
        raise KeyError(kind)
    common = {"featuresCol": "__features", "labelCol": LABEL, "predictionCol": "__index", "probabilityCol": "__probability", "rawPredictionCol": "__raw"}
    last = LogisticRegression(maxIter=12, regParam=0.02, standardization=False, **common)
    return Pipeline(stages=[SQLTransformer(statement=_TOKENS), *hashed_ngrams(), last, IndexToString(inputCol="__index", outputCol=SAID, labels=labels)]).fit(known)


def save(model: PipelineModel | WordBayes, path: str) -> None:
    """One that is there is replaced."""
    if isinstance(model, WordBayes):
        model.save(path)
        return
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | WordBayes:
    spark = SparkSession.active()
    try:
        meta = spark.read.schema(_BAYES_META).parquet(f"{path}/bayes").first()
        return WordBayes(list(meta["labels"]), list(meta["priors"]), spark.read.schema("word string, weights array<double>").parquet(f"{path}/words"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return PipelineModel.load(path)


@dataclass(frozen=True)
class Trained:
    """A fitted pipeline as a model under evaluation."""

    model: PipelineModel | WordBayes

    def add(self, rows: DataFrame, text: Column, into: str, scores: str | None = None) -> DataFrame:
        """Adds the predicted label, and if scores names a column, an array of the labels' unnormalised scores, in the order of the labels. A text without known words is judged by the labels' shares."""
        kept = rows.columns
        if isinstance(self.model, WordBayes):
            found, best = self.model.scored(rows, text, "__raw"), F.array_position("__raw", F.array_max("__raw")).cast("int")
            return found.select(*kept, F.element_at(F.array(*map(F.lit, self.model.labels)), best).alias(into), *([F.col("__raw").alias(scores)] if scores else []))
        found = self.model.transform(rows.withColumn(TEXT, text.cast("string")))
        return found.select(*kept, F.col(SAID).alias(into), *([vector_to_array("__raw").alias(scores)] if scores else []))


def acceptability_scorer(pairs: DataFrame, faulty: str, correct: str, kind: str = "logistic") -> PipelineModel:
    """Fitted on pairs: label 1 for the correct sentence, 0 for the faulty one; pairs of equal sentences teach nothing."""
    two = F.array(F.struct(F.col(faulty).alias("text"), F.lit("0").alias("label")), F.struct(F.col(correct).alias("text"), F.lit("1").alias("label")))
    return fit(pairs.where(F.col(faulty) != F.col(correct)).select(F.inline(two)), "text", "label", kind)


def with_acceptability(rows: DataFrame, scorer: PipelineModel, columns: Sequence[tuple[str, str]] = (("text", "input_score"), ("prediction", "corrected_score"))) -> DataFrame:
    """Adds, for each (column of texts, name), 1.0 where the scorer finds the text acceptable and 0.0 where not."""
    for text, name in columns:
        rows = Trained(scorer).add(rows, F.col(text), name)
        rows = rows.withColumn(name, (F.col(name) == "1").cast("double"))
    return rows


def acceptability(rows: DataFrame, scorer: PipelineModel, before: str, after: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, input, corrected, delta): the shares of acceptable sentences before and after correction."""
    return metrics.acceptability(with_acceptability(rows, scorer, ((before, "__before"), (after, "__after"))), "__before", "__after", by)
