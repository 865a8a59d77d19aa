"""Topics of a corpus: labels that a client gives to batches of texts, and canonical topics that own the labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import parse
from ..functions import text as T
from ..functions.vocab import STOPWORDS
from ..session import settled
from .generate import Client, answered, numbered

#: Characters of a text that are shown to the client, and of an example.
SHOWN, EXAMPLE = 300, 200
#: Labels in a question that consolidates them.
ASKED = 1000
#: Texts whose words are counted at once in Python, and models that are fitted at once.
AT_ONCE, FITTED = 1000, 4


def labelled(texts: DataFrame, key: str, prompt: str, client: Client, batch: int = 20, text: str = "text") -> DataFrame:
    """(key, text, label): labels for batches of texts; a text without a line in the answer has none. prompt has {texts}."""
    placed = numbered(texts.select(key, F.col(text).alias("text")), key).withColumn("batch", F.floor((F.col("n") - 1) / batch)).withColumn("at", (F.pmod(F.col("n") - 1, F.lit(batch)) + 1).cast("int"))
    line = F.concat(F.col("at").cast("string"), F.lit(". "), F.left(F.coalesce("text", F.lit("")), F.lit(SHOWN)))
    asked = placed.groupBy("batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"), F.count("*").cast("int").alias("size"))  # a batch is at most `batch` texts
    before, after = prompt.split("{texts}")
    said = answered(asked, F.concat(F.lit(before), F.col("lines"), F.lit(after)), client, "response")
    labels = said.select("batch", F.explode(parse.labels(F.col("response"), F.col("size"))).alias("x")).select("batch", F.col("x.place").alias("at"), F.nullif(T.stripped(F.col("x.label")), F.lit("")).alias("label"))
    return placed.join(labels, ["batch", "at"], "left").select(key, "text", "label")


def owners(labels: DataFrame, consolidated: Mapping[str, Mapping]) -> DataFrame:
    """(label, topic, description) for each label (label, n): the first topic that claims it, or else a topic of its own name."""
    blocks = [(k, name, block.get("description", ""), [*block.get("members", ())]) for k, (name, block) in enumerate(consolidated.items())]
    return claimed(labels, labels.sparkSession.createDataFrame(blocks, "k long, topic string, description string, members array<string>"))


def claimed(labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """owners, of topics in a frame (k, topic, description, members); the smallest k is first."""
    first = blocks.select("k", "topic", "description", F.explode("members").alias("m")).groupBy(F.lower(T.stripped(F.col("m"))).alias("label")).agg(F.min_by(F.struct("topic", "description"), "k").alias("o"))
    named = blocks.groupBy(F.col("topic").alias("name")).agg(F.min_by("description", "k").alias("its"))
    rows = labels.join(first, "label", "left").join(named, F.col("label") == F.col("name"), "left")
    return rows.select("label", "n", F.coalesce("o.topic", "label").alias("topic"), F.coalesce("o.description", "its", F.lit("")).alias("description"))


def topics(rows: DataFrame, consolidated: Mapping[str, Mapping] | DataFrame | None = None, key: str = "doc_id", examples: int = 3) -> DataFrame:
    """(topic, description, n, fraction, examples) of (key, text, label); fractions are of labelled texts and add up to 1. Without topics each label is one."""
    have = rows.where("label IS NOT NULL")
    counts = have.groupBy("label").agg(F.count("*").alias("n"))
    of = claimed(counts, consolidated) if isinstance(consolidated, DataFrame) else owners(counts, consolidated or {})
    found = of.groupBy("topic").agg(F.max("description").alias("description"), F.sum("n").alias("n")).withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # one row a topic
    order = Window.partitionBy("topic").orderBy(key)
    first = have.join(of.select("label", "topic"), "label").withColumn("k", F.row_number().over(order)).where(F.col("k") <= examples)
    shown = first.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", F.left("text", F.lit(EXAMPLE)).alias("t")))), lambda x: x["t"]).alias("examples"))
    return found.join(shown, "topic", "left")


def consolidations(counts: DataFrame, prompt: str, client: Client, most: int = ASKED) -> DataFrame:
    """(k, topic, description, members) that a client makes of all labels (label, n), the most frequent first, so many in a question. An answer without topics is asked for once more."""
    times = F.col("n")
    placed = numbered(counts.select(F.struct((-times).alias("n"), "label").alias("at"), F.concat("label", F.lit(" — "), times.cast("string")).alias("line")), "at").withColumn("batch", F.floor((F.col("n") - 1) / most))
    line = F.struct("n", "line")
    asked = placed.groupBy("batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("lines"))  # a batch is at most `most` labels
    before, after = prompt.split("{labels}")
    question = F.concat(F.lit(before), F.col("lines"), F.lit(after))
    said = settled(answered(asked, question, client, "one"))
    none = F.coalesce(F.size(parse.topics(F.col("one"))) < 1, F.lit(True))
    said = settled(answered(said, F.when(none, question), client, "two"))
    found = said.select("batch", F.posexplode(F.map_entries(parse.topics(F.when(none, F.col("two")).otherwise(F.col("one"))))).alias("at", "t")).where("t.value IS NOT NULL")
    return found.select((F.col("batch") * 1_000_000 + F.col("at")).alias("k"), F.col("t.key").alias("topic"), F.coalesce("t.value.description", F.lit("")).alias("description"), F.col("t.value.members").alias("members"))


def profile(texts: DataFrame, key: str, label_prompt: str, consolidate_prompt: str, client: Client, batch: int = 20, most: int = ASKED) -> DataFrame:
    """Both passes: labels, questions that consolidate them, topics. consolidate_prompt has {labels}; topics of one name in several answers are one, and labels that no topic claims stay topics of their own."""
    rows = settled(labelled(texts, key, label_prompt, client, batch))
    counts = rows.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    return topics(rows, settled(consolidations(counts, consolidate_prompt, client, most)), key)


def _coded(words: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """(texts, the text of each word, its code, the word of each code) of so many texts at a time."""
    for lo in range(0, max(len(words), 1), AT_ONCE):
        some = words.slice(lo, AT_ONCE)
        coded = some.flatten().dictionary_encode()
        yield len(some), np.repeat(np.arange(len(some)), pc.list_value_length(some).to_numpy(zero_copy_only=False)), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, rows): how often each word occurs, and in how many texts, in a part of them."""
    for batch in batches:
        for _, at, codes, kinds in _coded(batch.column(0)):
            pairs, n = np.unique(at * max(len(kinds), 1) + codes, return_counts=True)
            of = pairs % max(len(kinds), 1)
            totals = np.bincount(of, n, len(kinds)).astype(np.int64), np.bincount(of, minlength=len(kinds))
            yield pa.RecordBatch.from_arrays([kinds, *map(pa.array, totals)], ["word", "n", "rows"])


def _frequent(words: DataFrame, most: int, least_rows: int) -> list[str]:
    """The most frequent words that so many texts have, without stop words, ties in order of the words; words is a column of arrays."""
    counts = words.mapInArrow(_word_counts, "word string, n long, rows long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    return [r["word"] for r in counts.where((F.col("rows") >= least_rows) & ~F.col("word").isin(STOPWORDS)).orderBy(F.desc("n"), "word").limit(most).select("word").collect()]


def _vectors(vocabulary: Sequence[str]) -> Callable[[str], Column]:
    """Counts of the vocabulary's words in an array of words, as the parts of a sparse vector."""

    @F.arrow_udf("struct<type: tinyint, size: int, indices: array<int>, values: array<double>>")
    def vectors(words: pa.Array) -> pa.Array:
        size, found = len(vocabulary), []
        for rows, at, codes, kinds in _coded(words):
            of = pc.fill_null(pc.index_in(kinds, pa.array(vocabulary, kinds.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
            pairs, n = np.unique((at * size + of)[of >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(rows + 1) * size).astype(np.int32))
            indices, values = (pa.ListArray.from_arrays(ends, pa.array(v)) for v in ((pairs % size).astype(np.int32), n.astype(float)))
            found.append(pa.StructArray.from_arrays([pa.array(np.zeros(rows, np.int8)), pa.array(np.full(rows, size, np.int32)), indices, values], ["type", "size", "indices", "values"]))
        return pa.concat_arrays(found)

    return vectors


def modelled(texts: DataFrame, key: str, k: int, text: str = "text", vocabulary: int = 1 << 16, least_rows: int = 2, iterations: int = 20, seed: int = 0, words: int = 3) -> DataFrame:
    """(key, text, label) without a client, as labelled gives them: the topic with the largest share of each text in an online variational Dirichlet model of k topics over word counts, named by its heaviest words.

    The vocabulary is the most frequent words that so many texts have, stop words left out, ties in order of the words; it and the topics' weights (k times as many numbers) come to the driver. Texts without such words have no label. Equal seeds and tables of one
    order give equal topics.
    """
    read = texts.select(key, F.col(text).alias("text"), T.tokens(F.col(text)).alias("__words"))
    known = _frequent(read.select("__words"), vocabulary, least_rows)
    if not known:
        return texts.select(key, F.col(text).alias("text"), F.lit(None).cast("string").alias("label"))
    parts = read.select(key, "text", _vectors(known)("__words").alias("__counts"))
    parts = parts.select("*", (F.size("__counts.indices") > 0).alias("__any"))
    counted = settled(parts, "counts", StructType([StructField(f.name, VectorUDT()) if f.name == "__counts" else f for f in parts.schema]))
    model = LDA(k=k, maxIter=iterations, seed=seed, optimizer="online", featuresCol="__counts", topicDistributionCol="__shares").fit(counted.where("__any"))
    names = [" ".join(known[i] for i in r["termIndices"]) for r in sorted(model.describeTopics(words).collect(), key=lambda r: r["topic"])]
    shares = vector_to_array(F.col("__shares"))
    label = F.element_at(F.array(*map(F.lit, names)), F.array_position(shares, F.array_max(shares)).cast("int"))
    return model.transform(counted).select(key, "text", F.when(F.col("__any"), label).alias("label"))


def topics_by(texts: DataFrame, by: str, key: str, k: int, text: str = "text", **settings: int) -> DataFrame:
    """(by, topic, description, n, fraction, examples): topics of modelled texts for each value of a column, null too, that has a model with a vocabulary and k topics of its own; fractions are of the value's labelled texts.

    The values come to the driver, and FITTED models are fitted at once. Labels are stored with what an example shows, so that a model is applied once.
    """
    kind, shown = texts.schema[by].dataType, F.left("text", F.lit(EXAMPLE)).alias("text")

    def of(value: object) -> DataFrame:
        rows = modelled(texts.where(F.col(by).eqNullSafe(F.lit(value))), key, k, text, **settings)
        return topics(settled(rows.select(key, shown, "label"), "labels"), key=key).select(F.lit(value).cast(kind).alias(by), "*")

    with ThreadPoolExecutor(FITTED) as pool:
        found = [*pool.map(of, sorted((r[0] for r in texts.select(by).distinct().collect()), key=lambda v: (v is not None, v)))]
    return reduce(DataFrame.unionByName, found) if found else of(None)
