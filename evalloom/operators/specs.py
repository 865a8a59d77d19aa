"""Content specs drawn from a profile: a topic, a number of words and features of style.

A profile's slices are long frames: topics (name, fraction, description), bins (bin, share), rates of styles. They are some
tens of rows, read once by the driver; the draws are columns of the samples.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import STYLE_PHRASES
from . import sampling


def parse_bin(label: str) -> tuple[int, int | None]:
    low, _, high = label.rstrip("+").partition("-")
    return int(low), int(high) if high else None


def usable(profile: Mapping, topics_key: str = "topics") -> Mapping:
    """The profile; RuntimeError says what it lacks for drawing specs."""
    per_label = topics_key == "topics_per_label"
    blocks = ("length_distributions_per_label", "style_per_label") if per_label else ("length_distributions", "style")
    if profile.get("profile_version", 1) < 2:
        raise RuntimeError("the profile is of a version below 2")
    found = profile.get(topics_key) or {}
    if not (any(map(topics_of, found.values())) if per_label else topics_of(found)):
        raise RuntimeError(f"the profile has no {topics_key}")
    if lacking := [b for b in blocks if not profile.get(b)]:
        raise RuntimeError(f"the profile has no {', '.join(lacking)}")
    return profile


def topics_of(block: Mapping) -> Mapping:
    """The topics of a block that has them below `topics`, or is them."""
    return (block["topics"] or {}) if "topics" in block else block


def slice_of(profile: Mapping, label: str | None = None, side: str = "correct") -> tuple[Mapping, Mapping, Mapping]:
    """Topics, word lengths and style of a label, or of a side of pairs."""
    suffix, name = ("_per_label", label) if label is not None else ("", side)
    topics = (profile.get("topics" + suffix) or {}).get(label) or {} if label is not None else profile.get("topics") or {}
    lengths = ((profile.get("length_distributions" + suffix) or {}).get(name) or {}).get("words") or {}
    return topics_of(topics), lengths, (profile.get("style" + suffix) or {}).get(name) or {}


def content_spec(key: Column, topics: Mapping, lengths: Mapping, style: Mapping, seed: int) -> Column:
    """A struct (topic, topic_description, target_words, style_features) for each key."""
    topic = sampling.choice(sampling.uniform(key, "topic", seed), {t: float(b.get("fraction", 0)) for t, b in topics.items()})
    label = sampling.choice(sampling.uniform(key, "length", seed), {b: float(p) for b, p in (lengths.get("bins") or {}).items()})
    low = high = F.lit(None).cast("int")
    for name in lengths["bins"]:
        a, b = parse_bin(name)
        b = b if b is not None else max(a, int((lengths.get("quantiles") or {}).get("p90", a)))
        low, high = F.when(label == name, a).otherwise(low), F.when(label == name, b).otherwise(high)
    words = sampling.whole_number(sampling.uniform(key, "words", seed), low, high)
    about = F.lit("")
    for name, block in topics.items():
        about = F.when(topic == name, block.get("description", "")).otherwise(about)
    rates = {k: float(r) for k, r in style.items() if k in STYLE_PHRASES}
    features = sampling.features(key, rates, seed) if rates else F.array().cast("array<string>")
    return F.struct(topic.alias("topic"), about.alias("topic_description"), words.alias("target_words"), features.alias("style_features"))


def rendered(spec: Column) -> Column:
    """The spec in words."""
    phrases = F.create_map(*(F.lit(x) for kv in STYLE_PHRASES.items() for x in kv))
    style = F.array_join(F.transform(spec["style_features"], lambda f: F.try_element_at(phrases, f)), "; ")
    about = F.when(spec["topic_description"] != "", F.concat(F.lit(" ("), spec["topic_description"], F.lit(")"))).otherwise("")
    return F.concat(F.lit("Topic: "), spec["topic"], about, F.lit("; roughly "), spec["target_words"].cast("string"), F.lit(" words"), F.when(style != "", F.concat(F.lit("; "), style)).otherwise(""))


def drawn(samples: DataFrame, profile: Mapping, seed: int, label: str | None = None, side: str = "correct", key: str = "i") -> DataFrame:
    """samples with spec and seed, the spec in words."""
    rows = samples.withColumn("spec", content_spec(F.col(key), *slice_of(profile, label, side), seed))
    return rows.withColumn("seed", rendered(F.col("spec")))
