"""Answers kept by what was asked: a table of prompt hashes and responses, joined before a client is asked, so that a stage that is tried again asks only for what is lacking.

The table is a folder of parts, each written once; a prompt's answer is the one of the smallest part, so that all readers see the same one. Calls that failed (null) are kept apart with the number of their tries, and asked again.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled
from .generate import Client, answered

SCHEMA = "key string, prompt string, response string, part string"


def prompt_key(prompt: Column, model: str) -> Column:
    """What a prompt to a model is known by."""
    return F.sha2(F.concat_ws("\u0000", F.lit(model), prompt), 256)


def kept(spark: SparkSession, path: str, failed: bool = False) -> DataFrame:
    """(key, prompt, response) of all prompts that have an answer, or (key, prompt, tries) of those that had none."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(f"{path}/{'failed' if failed else 'answers'}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SCHEMA)
    if failed:
        return rows.groupBy("key").agg(F.first("prompt").alias("prompt"), F.count("*").alias("tries"))
    return rows.groupBy("key").agg(F.min(F.struct("part", "prompt", "response")).alias("x")).select("key", "x.prompt", "x.response")


def remembered(rows: DataFrame, prompt: Column, client: Client, model: str, path: str, into: str = "response") -> DataFrame:
    """Adds the client's answers. A prompt is asked once, however many rows have it, and not at all if the table at path knows it; null prompts are not asked. The new answers are added to the table before the rows are."""
    spark, part = rows.sparkSession, uuid.uuid4().hex
    keyed = rows.withColumn("__prompt", prompt).withColumn("__key", F.when(F.col("__prompt").isNotNull(), prompt_key(F.col("__prompt"), model)))
    wanted = keyed.where("__key IS NOT NULL").groupBy(F.col("__key").alias("key")).agg(F.first("__prompt").alias("prompt"))
    lacking = wanted.join(kept(spark, path).select("key"), "key", "left_anti")
    new = settled(answered(lacking, F.col("prompt"), client, "response").withColumn("part", F.lit(part)).select(*(c.split()[0] for c in SCHEMA.split(", "))), "answers")
    for name, found in (("answers", new.where("response IS NOT NULL")), ("failed", new.where("response IS NULL"))):
        if not found.isEmpty():
            found.write.mode("append").parquet(f"{path}/{name}")
    known = kept(spark, path).select(F.col("key").alias("__key"), F.col("response").alias("__response"))
    return keyed.join(known, "__key", "left").select(*(c for c in rows.columns if c != into), F.col("__response").alias(into))
