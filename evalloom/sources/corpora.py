"""Scans of text corpora: delimited files, edited sentences in M2 blocks, and fields that go by several names.

Every scan of files adds nothing to the rows; where an order matters ("the first n"), it is a column of the caller's.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# The names that fields go by, in order of preference.
SEED_NAMES = ("text", "correct", "target")
INPUT_NAMES = ("input", "text", "incorrect")
OUTPUT_NAMES = ("output", "correct", "target")
MESSAGE_NAMES = ("text", "message", "sms")
OPINION_NAMES = ("text", "sentence", "review")
FORMATS = {".m2": "m2", ".csv": "csv", ".tsv": "tsv"}


def csv(spark: SparkSession, path: str | list[str], sep: str = ",", names: Sequence[str] | None = None) -> DataFrame:
    """All columns as strings; quoted values may hold line ends and doubled quotes. names: for files without a header."""
    reader = spark.read.option("sep", sep).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").option("nullValue", None).option("emptyValue", "")
    if names:
        return reader.schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    return reader.option("header", True).csv(path)


def tsv(spark: SparkSession, path: str | list[str], names: Sequence[str] | None = None) -> DataFrame:
    return csv(spark, path, "\t", names)


def m2_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(tokens, edits) of each block; edits are (start, end, type, correction, annotator). Lines that are not whole edits are left out."""
    first = spark.read.option("lineSep", "\n").text(path).first()
    ends = "\r\n\r\n" if first and first.value.endswith("\r") else "\n\n"  # only where files are cut for tasks; blocks are told apart below
    text = spark.read.option("lineSep", ends).text(path).select(F.explode(F.split("value", r"\r?\n[ \t]*\r?\n")).alias("value"))
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.rtrim(x)), lambda x: T.stripped(x) != "")
    rows = text.select(lines.alias("lines")).where(F.startswith(F.get("lines", F.lit(0)), F.lit("S ")))

    def edit(line: Column) -> Column:
        parts = F.split(F.substring(line, 3, 1 << 30), r"\|\|\|")
        span = T.spaced(F.get(parts, F.lit(0)))
        return F.when(
            F.size(parts) >= 6,
            F.struct(
                F.get(span, F.lit(0)).cast("int").alias("start"),
                F.get(span, F.lit(1)).cast("int").alias("end"),
                F.get(parts, F.lit(1)).alias("type"),
                F.get(parts, F.lit(2)).alias("correction"),
                F.get(parts, F.lit(5)).cast("int").alias("annotator"),
            ),
        )

    edits = F.array_compact(F.transform(F.filter("lines", lambda x: F.startswith(x, F.lit("A "))), edit))
    return rows.select(T.spaced(F.substring(F.get("lines", F.lit(0)), 3, 1 << 30)).alias("tokens"), edits.alias("edits"))


def applied(tokens: Column, edits: Column) -> Column:
    """The tokens after the edits, the last span first, so that earlier spans stay where they are."""
    last_first = F.reverse(F.sort_array(F.transform(edits, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["correction"].alias("correction")))))

    def put(words: Column, e: Column) -> Column:
        return F.concat(F.slice(words, F.lit(1), e["start"]), T.spaced(e["correction"]), F.slice(words, e["end"] + 1, F.greatest(F.size(words) - e["end"], F.lit(0))))

    return F.aggregate(last_first, tokens, put)


def m2(spark: SparkSession, path: str | list[str], annotator: int = 0) -> DataFrame:
    """(incorrect, correct) of the sentences that this annotator has changed."""
    mine = F.filter("edits", lambda e: (e["annotator"] == annotator) & (e["correction"] != "-NONE-"))
    rows = m2_blocks(spark, path).select("tokens", mine.alias("edits")).where(F.size("edits") > 0)
    return rows.select(F.array_join("tokens", " ").alias("incorrect"), F.array_join(applied(F.col("tokens"), F.col("edits")), " ").alias("correct"))


def format_of(path: str) -> str | None:
    return next((f for end, f in FORMATS.items() if path.lower().endswith(end)), None)


def local(spark: SparkSession, path: str, kind: str | None = None, annotator: int = 0) -> DataFrame:
    """A file of a known format; ValueError names the path if there is none or its format is unknown."""
    kind = kind or format_of(path)
    readers = {"m2": lambda: m2(spark, path, annotator), "csv": lambda: csv(spark, path), "tsv": lambda: tsv(spark, path), "parquet": lambda: spark.read.parquet(path)}
    if kind not in readers:
        raise ValueError(f"{path}: unknown format; one of {', '.join(readers)}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
        raise ValueError(f"{path}: no such file")
    return readers[kind]()


def dataset_settings(config: Mapping, block: str = "dataset") -> dict:
    """What a configuration says of its data: keys of the nested block go before flat ones; the source is a hub unless told."""
    flat = {k.removeprefix(f"{block}_"): v for k, v in config.items() if k.startswith(f"{block}_")}
    nested = config.get(block)
    found = flat | (dict(nested) if isinstance(nested, Mapping) else {"name": nested} if nested else {})
    return {"source": "local" if found.get("path") and "source" not in found else "huggingface"} | found


def dataset(spark: SparkSession, settings: Mapping) -> DataFrame:
    """The rows that settings name. A hub's data set is read from a folder of Parquet, `<root>/<name>[/<subset>]/<split>`, as no hub is reached from here."""
    if settings.get("source") == "local":
        return local(spark, settings["path"], settings.get("format"), settings.get("annotator_id", 0))
    parts = [settings.get("root", "."), settings["name"], settings.get("subset"), settings.get("split", "train")]
    return spark.read.parquet("/".join(p for p in parts if p))


def field(rows: DataFrame, names: Sequence[str]) -> Column:
    """The first of these columns that is neither null nor empty; null if the frame has none of them."""
    have = [F.col(f"`{n}`").cast("string") for n in names if n in rows.columns]
    return T.first_nonempty(*have) if have else F.lit(None).cast("string")


def pairs(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(incorrect, correct) where both are there."""
    found = rows.select(*keep, field(rows, INPUT_NAMES).alias("incorrect"), field(rows, OUTPUT_NAMES).alias("correct"))
    return found.where("incorrect IS NOT NULL AND correct IS NOT NULL")


def seeds(rows: DataFrame, keep: Sequence[str] = (), names: Sequence[str] = SEED_NAMES) -> DataFrame:
    """(seed): the first text of any data set's rows that is neither null nor empty, by the names that such columns have; ValueError if the frame has none of them, for any other column would be a guess."""
    if not {*names} & {*rows.columns}:
        raise ValueError(f"none of the columns {', '.join(names)}; there are {', '.join(rows.columns)}")
    return rows.select(*keep, field(rows, names).alias("seed")).where("seed IS NOT NULL")


def ham(rows: DataFrame, keep: Sequence[str] = (), label: str = "label") -> DataFrame:
    """(incorrect): messages whose label, not stripped, is neither spam nor 1; those without a label stay."""
    said = F.lower(F.coalesce(F.col(label).cast("string"), F.lit(""))) if label in rows.columns else F.lit("")
    return rows.where(~said.isin("spam", "1")).select(*keep, field(rows, MESSAGE_NAMES).alias("incorrect")).where("incorrect IS NOT NULL")


def messages(rows: DataFrame, keep: Sequence[str] = (), label: str = "label") -> DataFrame:
    """(text, label) of both classes; blank texts go."""
    have = [F.when(~T.blank(F.col(f"`{n}`").cast("string")), T.stripped(F.col(f"`{n}`").cast("string"))) for n in MESSAGE_NAMES if n in rows.columns]
    text = F.coalesce(*have) if have else F.lit(None).cast("string")
    return rows.select(*keep, text.alias("text"), T.normalised_spam_label(F.col(label)).alias("label")).where("text IS NOT NULL")


def opinions(rows: DataFrame, keep: Sequence[str] = (), label: str = "label") -> DataFrame:
    """(incorrect, sentiment_label)."""
    return rows.select(*keep, field(rows, OPINION_NAMES).alias("incorrect"), T.sentiment_label(F.col(label)).alias("sentiment_label")).where("incorrect IS NOT NULL")


def first_usable(usable: DataFrame, order: str, n: int | None = None, told: bool = False) -> DataFrame:
    """The first n of the rows that a parser has kept (all if n is None): the limit comes after the filter. told warns if there are fewer, which counts the rows."""
    if n is None:
        return usable
    found = usable.orderBy(order).limit(n)
    if told and (have := found.count()) < n:
        warnings.warn(f"{have} usable rows of {n} that were asked for", stacklevel=2)
    return found
