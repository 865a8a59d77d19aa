"""Generation of samples through a client that answers prompts.

The draws, prompts, parsing and filters are columns; only the call itself runs in Python, an Arrow batch at a time, on
executors. Each sample is one row with the reason for its rejection, or none, so that counts of what was dropped are
groupings of the same frame. A stored frame is meant to stand between the calls and whatever reads it twice, for a
client need not answer alike twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..functions import text as T
from ..session import settled
from . import sampling

POLICIES = ("cross_class", "same_class", "none")
#: Characters of responses that a task holds before it passes them on.
PASSED_ON = 1 << 21


@dataclass(frozen=True)
class Client:
    """answer takes a prompt and gives a response; it is sent to executors. A call that raises is tried again, with twice the pause each time; then the response is null."""

    answer: Callable[[str], str]
    delay: float = 0.0
    tries: int = 3
    pause: float = 1.0
    parallel: int | None = None


def answered(rows: DataFrame, prompt: Column, client: Client, into: str) -> DataFrame:
    """Adds the client's responses; a null prompt is not asked. parallel bounds how many tasks ask at once."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            found, size = [], 0
            for p in prompts:
                said = None
                for k in range(client.tries if p is not None else 0):
                    try:
                        said = client.answer(p)
                        break
                    except Exception:  # whatever a client's library raises; the sample counts as failed
                        time.sleep(client.pause * 2**k if k + 1 < client.tries else 0)
                if client.delay and p is not None:
                    time.sleep(client.delay)
                found.append(said)
                size += len(said or "")
                if size > PASSED_ON:  # a whole batch's responses are never held
                    yield pd.Series(found, dtype=object)
                    found, size = [], 0
            if found or not len(prompts):
                yield pd.Series(found, dtype=object)

    if client.parallel:
        rows = rows.repartition(client.parallel)
    return rows.withColumn(into, ask(prompt))


def filled(template: str, **values: Column) -> Column:
    """The template with {name} replaced by columns, once each and left to right; {{ and }} are braces."""
    parts, rest = [], template.replace("{{", "\0").replace("}}", "\1")
    while True:
        at = min((rest.find("{" + n + "}") for n in values if "{" + n + "}" in rest), default=-1)
        if at < 0:
            break
        name = next(n for n in values if rest.startswith("{" + n + "}", at))
        parts += [F.lit(rest[:at].replace("\0", "{").replace("\1", "}")), F.coalesce(values[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts, F.lit(rest.replace("\0", "{").replace("\1", "}")))


def numbered(rows: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds n, the place in the order from 1 (within a group): places within sorted partitions, plus the rows of those before."""
    ordered = settled(rows.orderBy(*by, order).withColumn("__m", F.monotonically_increasing_id()))  # both readers must see the same partitions
    part = F.shiftright("__m", 33)
    sizes = ordered.groupBy(part.alias("__p")).agg(F.count("*").alias("__c"))
    before = sizes.withColumn("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    placed = ordered.withColumn("__p", part).join(F.broadcast(before.select("__p", "__b")), "__p").withColumn("n", F.col("__b") + F.col("__m").bitwiseAND((1 << 33) - 1) + 1)
    placed = placed.drop("__p", "__m", "__b")
    if by:
        least = placed.groupBy(*by).agg(F.min("n").alias("__l"))
        placed = placed.join(least, [*by]).withColumn("n", F.col("n") - F.col("__l") + 1).drop("__l")
    return placed


def described(keys: Column, descriptions: Mapping[str, str]) -> Column:
    """What each key asks for, joined by '; '; a key without a description stands for itself."""
    table = F.create_map(*(F.lit(x) for kv in descriptions.items() for x in kv)) if descriptions else F.create_map().cast("map<string,string>")
    return F.array_join(F.transform(keys, lambda k: F.coalesce(F.try_element_at(table, k), k)), "; ")


def cycled(samples: DataFrame, pool: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each sample (i) with the row of the pool (n) whose turn it is: the pool is gone through again and again (group by group)."""
    if by:
        size = pool.groupBy(*by).agg(F.max("n").alias("__size"))
        turns = samples.join(size, [*by], "left")
    else:
        turns = samples.crossJoin(F.broadcast(pool.agg(F.max("n").alias("__size"))))  # one row
    turns = turns.withColumn("n", F.pmod(F.col("i") - 1, F.col("__size")) + 1).drop("__size")
    return turns.join(pool, [*by, "n"], "left").drop("n")


def samples(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias("i"))


def _judged(rows: DataFrame, judge_prompt: str | None, sentence: str, correction: str, judge: Client) -> DataFrame:
    """Rows not rejected so far that have something to compare with are put to the judge."""
    if not judge_prompt:
        return rows
    asks = F.when(F.col("rejected").isNull() & (F.coalesce(correction, F.lit("")) != ""), filled(judge_prompt, sentence=F.col(sentence), correction=F.col(correction)))
    rows = answered(rows, asks, judge, "verdict")
    dropped = F.col("verdict").isNotNull() & ~parse.judge_keeps(F.col("verdict"))
    return rows.withColumn("rejected", F.coalesce("rejected", F.when(dropped, "judge dropped"))).drop("verdict")


def _failed(response: Column, tag: str) -> Column:
    """A response that is missing, or a refusal without the tag."""
    has_tag = F.regexp_like(response, F.lit(rf"(?im)^\s*{tag}:\s*(.+?)\s*$"))
    return F.when(response.isNull(), "call failed").when(~has_tag & parse.is_refusal(response), "refused")


def class_conditional(
    spark: SparkSession,
    client: Client,
    n: int,
    *,
    labels: tuple[str, str],
    positive_share: float,
    types: Mapping[str, float],
    counts: Mapping[int, float],
    descriptions: Mapping[str, str],
    prompts: Mapping[str, str],
    policy: str = "cross_class",
    seeds: DataFrame | None = None,
    judge_prompt: str | None = None,
    judge: Client | None = None,
    seed: int = 0,
) -> DataFrame:
    """(i, text, label, technique, seed, rejected). labels: positive, negative. seeds: (n, seed[, label]); with policy none (n, label, seed) holds specs.

    cross_class: every seed serves both classes; prompts inject and rewrite. same_class: a seed of the drawn class; prompt imitate.
    none: a spec of the drawn class; a prompt for each label.
    """
    if policy not in POLICIES:
        raise ValueError(f"{policy!r}: not one of {', '.join(POLICIES)}")
    needed = {"cross_class": ("inject", "rewrite"), "same_class": ("imitate",), "none": labels}[policy]
    if missing := [p for p in needed if not prompts.get(p)]:
        raise ValueError(f"policy {policy} needs prompts for: {', '.join(missing)}")
    if seeds is None:
        raise ValueError(f"policy {policy} needs seeds or specs")
    if policy != "cross_class" and (lacking := {*labels} - {r.label for r in seeds.select("label").where(F.col("label").isin(*labels)).distinct().collect()}):  # two rows at most
        raise ValueError(f"policy {policy} has nothing to start from for: {', '.join(sorted(lacking))}")
    positive, negative = labels
    key = F.col("i")
    rows = samples(spark, n).withColumn("label", F.when(sampling.uniform(key, "class", seed) < positive_share, positive).otherwise(negative))
    rows = cycled(rows, seeds.select("n", "seed")) if policy == "cross_class" else cycled(rows, seeds.select("label", "n", "seed"), ["label"])
    is_positive = F.col("label") == positive
    number = sampling.choice(sampling.uniform(key, "count", seed), {str(k): w for k, w in counts.items()}).cast("int")
    keys = F.when(is_positive, sampling.distinct_choices(key, number, types, seed)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("keys", F.array().cast("array<string>") if policy == "same_class" else keys)
    spec, source = described(F.col("keys"), descriptions), F.col("seed")
    if policy == "cross_class":
        prompt = F.when(is_positive, filled(prompts["inject"], sentence=source, error_spec=spec)).otherwise(filled(prompts["rewrite"], sentence=source))
        tag = F.when(is_positive, "Corrupted").otherwise("Rewritten")
    elif policy == "same_class":
        prompt, tag = filled(prompts["imitate"], sentence=source, class_name=F.col("label")), F.lit("Rewritten")
    else:
        prompt, tag = F.when(is_positive, filled(prompts[positive], spec=source, error_spec=spec)).otherwise(filled(prompts[negative], spec=source)), F.lit("Message")
    technique = F.lit("imitation") if policy == "same_class" else F.when(is_positive, F.array_join("keys", ", ")).otherwise("paraphrase")
    has_seed = F.coalesce(source, F.lit("")) != ""
    rows = answered(rows.withColumn("technique", technique), F.when(has_seed, prompt), client, "response")
    response = F.col("response")
    tags = ("Corrupted", "Rewritten", "Message")
    text, failed = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in tags:
        text = F.when(tag == name, parse.tagged(response, name)).otherwise(text)
        failed = F.when(tag == name, _failed(response, name)).otherwise(failed)
    rows = rows.withColumn("text", text)
    if policy == "none":
        rows = rows.withColumn("seed", F.lit(""))
    same = (F.col("seed") != "") & (T.stripped(F.col("text")) == T.stripped(F.col("seed")))
    rejected = (
        F.when(~has_seed if policy != "none" else F.lit(False), "missing seed")
        .when(failed.isNotNull(), failed)
        .when(F.coalesce("text", F.lit("")) == "", "parse failed")
        .when(same, "identical to seed")
        .when(F.size(T.spaced(F.col("text"))) < 3, "too short")
    )
    rows = rows.withColumn("rejected", rejected)
    rows = _judged(rows, judge_prompt if policy != "none" else None, "text", "seed", judge or client)
    return rows.select("i", "text", "label", "technique", F.coalesce("seed", F.lit("")).alias("seed"), "rejected")


def pairs(
    spark: SparkSession,
    client: Client,
    n: int,
    *,
    prompt: str,
    seeds: DataFrame,
    mode: str = "forward",
    types: Mapping[str, float] | None = None,
    counts: Mapping[int, float] | None = None,
    descriptions: Mapping[str, str] | None = None,
    error_types: Sequence[str] = (),
    judge_prompt: str | None = None,
    judge: Client | None = None,
    seed: int = 0,
) -> DataFrame:
    """(i, original, corrupted, error_type, rejected). forward: the client writes both sides of a pair after a seed (n, seed).

    inverse: it puts drawn faults into a clean text. seedless: seeds are specs, and it writes both sides with drawn faults.
    """
    rows = cycled(samples(spark, n), seeds.select("n", "seed"))
    key = F.col("i")
    if mode == "forward":
        any_type = F.element_at(F.array(*map(F.lit, error_types)), (F.floor(sampling.uniform(key, "type", seed) * len(error_types)) + 1).cast("int")) if error_types else F.lit("unknown")
        rows = rows.withColumn("drawn", any_type)
        asks = filled(prompt, sentence=F.col("seed"), spec=F.col("seed"), error_type=F.col("drawn"))
    elif mode in ("inverse", "seedless"):
        if not types or not counts:
            raise ValueError(f"mode {mode} needs a distribution of types and of their number")
        number = sampling.choice(sampling.uniform(key, "count", seed), {str(k): w for k, w in counts.items()}).cast("int")
        rows = rows.withColumn("keys", sampling.distinct_choices(key, number, types, seed)).withColumn("drawn", F.array_join("keys", ", "))
        asks = filled(prompt, sentence=F.col("seed"), spec=F.col("seed"), error_spec=described(F.col("keys"), descriptions or {}))
    else:
        raise ValueError(f"{mode!r}: not one of forward, inverse, seedless")
    rows = answered(rows, F.when(F.coalesce("seed", F.lit("")) != "", asks), client, "response")
    response = F.col("response")
    if mode == "inverse":
        rows = rows.select("i", F.col("seed").alias("original"), parse.tagged(response, "Corrupted").alias("corrupted"), F.col("drawn").alias("error_type"), _failed(response, "Corrupted").alias("failed"))
    else:
        found = parse.generation(response)
        rows = rows.select("i", found["gold"].alias("original"), found["corrupted"].alias("corrupted"), F.coalesce(found["error_type"] if mode == "forward" else F.lit(None).cast("string"), "drawn").alias("error_type"), _failed(response, "Generated").alias("failed"))
    rows = rows.withColumn("rejected", F.coalesce("failed", parse.rejection(F.col("corrupted"), F.col("original")))).drop("failed")
    return _judged(rows, judge_prompt, "corrupted", "original", judge or client)


def carriers(spark: SparkSession, client: Client, n: int, *, prompt: str, specs: DataFrame, tag: str = "Sentence") -> DataFrame:
    """(i, text, rejected): clean texts after specs (n, seed)."""
    rows = answered(cycled(samples(spark, n), specs.select("n", "seed")), filled(prompt, spec=F.col("seed")), client, "response")
    rows = rows.select("i", parse.tagged(F.col("response"), tag).alias("text"), _failed(F.col("response"), tag).alias("failed"))
    missing = F.when(F.coalesce("text", F.lit("")) == "", "parse failed").when(F.size(T.spaced(F.col("text"))) < 3, "too short")
    return rows.select("i", "text", F.coalesce("failed", missing).alias("rejected"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("rejected IS NULL").drop("rejected")


def some_accepted(rows: DataFrame) -> DataFrame:
    """accepted(rows); RuntimeError if there are none, as nothing could be scored."""
    if (found := accepted(rows)).isEmpty():
        raise RuntimeError("no sample was generated")
    return found


def drops(rows: DataFrame) -> DataFrame:
    """(rejected, n): how many were kept (null), and how many went why."""
    return rows.groupBy("rejected").agg(F.count("*").alias("n"))


def variants(seeds: DataFrame, grid: DataFrame, most: int = 10_000) -> DataFrame:
    """Every seed with every variant of prompt and setting; ValueError if a grid is larger than a settings' table can be."""
    if grid.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} variants")
    return seeds.crossJoin(F.broadcast(grid))


def shots(pairs: Sequence[tuple[str, str]]) -> str:
    """Worked examples to stand before a question."""
    return "".join(f"Example {k}:\nInput: {a}\nOutput: {b}\n\n" for k, (a, b) in enumerate(pairs, 1))


def prompt_grid(spark: SparkSession, wordings: Mapping[str, str], demonstrations: Sequence[tuple[str, str]], counts: Sequence[int] = (0, 1, 3, 12), temperatures: Sequence[float] = (0.0,)) -> DataFrame:
    """(variant, system, examples, temperature): each wording with so many of the demonstrations and each temperature; ValueError if a count asks for more than there are. Meant for variants()."""
    if max(counts, default=0) > len(demonstrations):
        raise ValueError(f"{len(demonstrations)} demonstrations are fewer than {max(counts)}")
    rows = [(f"{name}_{n}_{t:g}", system, shots(demonstrations[:n]), float(t)) for name, system in wordings.items() for n in counts for t in temperatures]
    return spark.createDataFrame(rows, "variant string, system string, examples string, temperature double")


def from_scenarios(rows: DataFrame, key: str, scenarios: Sequence[tuple[str, str, str]], seed: int = 0, noise: float = 0.2) -> DataFrame:
    """(key, input, output, error_category): for each row one of the scenarios (correct, incorrect, category), drawn by its key; at the rate of noise, letters of an input are swapped, too. No client is asked."""
    of = F.col(key)
    table = F.array(*(F.struct(F.lit(b).alias("input"), F.lit(a).alias("output"), F.lit(c).alias("error_category")) for a, b, c in scenarios))
    drawn = rows.withColumn("s", F.element_at(table, F.floor(sampling.uniform(of, "scenario", seed) * len(scenarios)).cast("int") + 1))
    swapped = F.replace(F.replace("s.input", F.lit("the"), F.lit("teh")), F.lit("ing"), F.lit("ign"))
    return drawn.select(key, F.when(sampling.uniform(of, "noise", seed) < noise, swapped).otherwise(F.col("s.input")).alias("input"), "s.output", "s.error_category")


def offline(prompt: str) -> str:
    """A client without a model, for tests: it answers in all tags, with a word doubled and one left out of the prompt's last line."""
    words = prompt.strip().splitlines()[-1].split() or ["empty"]
    changed = " ".join([*words[:1], *words[:1], *words[2:], "now"])
    clean = " ".join(words)
    return f"Error type: R:SPELL\nGenerated: {changed}\nGround truth: {clean}\nCorrupted: {changed}\nRewritten: {changed}\nMessage: {changed}\nSentence: {clean}\nRedundancy: valid\nCorrection: correct"
