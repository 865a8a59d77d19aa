"""A corpus pipeline in five stages. Each takes what its predecessor kept, and all but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import minhash, mixing, pieces, secrets, toxicity
from evalloom.llm.shared import stored

#: Words in a shingle of the near-duplicate stage; op2's contract of two is its own.
SHINGLE_WORDS = 5


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Null and empty texts stay; repeated rows are rated alike; other columns, whatever their names, stay as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return toxicity.rated(rows, docs, labels).where("predicted = 0").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates by five-word shingles stays. Rows of one id are one document, which stays or goes as a whole; documents without words or id stay; other columns play no part."""
    gone = minhash.near_duplicates(docs, SHINGLE_WORDS).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets, and n_chars follows where there were any. Null texts stay null; other columns stay as they are."""
    found = secrets.scan(docs, spans="__secrets")
    text = secrets.redacted(F.col("text"), F.col("__secrets"))
    n_chars = F.when(F.size("__secrets") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.select(*({"text": text.alias("text"), "n_chars": n_chars.alias("n_chars")}.get(c, F.col(c)) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; rows of equal id, source and text are one document. A null source is a source; documents without words are taken as the draw says; other columns stay as they are."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces, their number, and whether they decode to the text again (null texts are empty ones). Columns of a document's own that are named like these three are replaced, others stay as they are."""
    rows = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ids="__ids", decoded="__decoded")
    new = {"ids": F.col("__ids"), "n_tokens": F.size("__ids").cast("long"), "same_text": F.col("__decoded") == F.coalesce("text", F.lit(""))}
    return rows.select(*(c for c in docs.columns if c not in new), *(c.alias(n) for n, c in new.items()))


STAGES = [
    ("toxicity", toxic),
    ("near-duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", mixed),
    ("pieces", encoded),
]

#: SQL can express neither the toxicity model nor the draws of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again, over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
