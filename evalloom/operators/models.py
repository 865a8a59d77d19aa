"""Models under evaluation: a name stands for a column of predictions. A model that runs in Python is loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import trained as fitted

Predictor = Callable[[Column], Column] | fitted.Trained


def loaded(load: Callable[[], Callable[[list[str]], list[str]]]) -> Predictor:
    """load gives a function of a list of texts; it is called once a Python worker's task, and the function once a batch."""

    @F.pandas_udf("string")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()), dtype=object)

    return predict


def by_signals(least: int = 1) -> Predictor:
    """SPAM from so many signals on."""
    return lambda text: F.when(F.size(T.signals(text)) >= least, "SPAM").otherwise("HAM")


def by_words(positive: tuple[str, ...] = ("good", "great", "love"), negative: tuple[str, ...] = ("bad", "terrible", "hate")) -> Predictor:
    def number(text: Column, of: tuple[str, ...]) -> Column:
        return F.size(F.filter(T.tokens(text), lambda w: w.isin(*of)))

    def predict(text: Column) -> Column:
        up, down = number(text, positive), number(text, negative)
        return F.when(up > down, "POSITIVE").when(up < down, "NEGATIVE").otherwise("NEUTRAL")

    return predict


def unchanged() -> Predictor:
    return lambda text: text


def words_replaced(table: dict[str, str]) -> Predictor:
    """A corrector that looks words up."""
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return lambda text: F.array_join(F.transform(T.spaced(text), lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")


def trained(path: str) -> fitted.Trained:
    """A pipeline that trained.save has written."""
    return fitted.Trained(fitted.load(path))


#: Models by task and name.
REGISTRY: dict[str, dict[str, Callable[..., Predictor]]] = {
    "spam": {"signals": by_signals, "trained": trained},
    "sentiment": {"words": by_words, "trained": trained},
    "gec": {"unchanged": unchanged, "words_replaced": words_replaced},
}


def predictor(task: str, name: str, **options) -> Predictor:
    try:
        return REGISTRY[task][name](**options)
    except KeyError:
        raise ValueError(f"no model {name!r} for task {task!r}; there are {sorted(REGISTRY.get(task, {}))}") from None


def predicted(rows: DataFrame, models: dict[str, Predictor], text: str = "text") -> DataFrame:
    """One row a sample and model, with (model, prediction): one pass over the samples for all models."""
    kept, said = rows.columns, {}
    for k, (name, p) in enumerate(models.items()):
        said[name] = F.col(f"__said{k}") if isinstance(p, fitted.Trained) else p(F.col(text))
        rows = p.add(rows, F.col(text), f"__said{k}") if isinstance(p, fitted.Trained) else rows
    each = F.array(*(F.struct(F.lit(n).alias("model"), c.alias("prediction")) for n, c in said.items()))
    return rows.select(*kept, F.inline(each))
