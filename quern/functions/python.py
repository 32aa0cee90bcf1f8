"""Python functions over Arrow batches: by value, by group, and from a row to many."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType


@F.pandas_udf(LongType())
def check_digits(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """97 less the key's remainder by 97, as bank numbers have it; null stays null."""
    for k in keys:
        yield 97 - k % 97


@F.pandas_udf(DoubleType())
def weighted_mean(values: pd.Series, weights: pd.Series) -> float:
    """Of a group; null if its weights sum to 0 or it has no whole pair."""
    both = pd.DataFrame({"v": values, "w": weights}).dropna()
    total = both["w"].sum()
    return float((both["v"] * both["w"]).sum() / total) if total else None


@F.udf(StringType(), useArrow=True)
def initials(name: str | None) -> str | None:
    """First characters of the words, for each row by itself."""
    return None if name is None else "".join(w[0] for w in name.split(" ") if w)


@F.udtf(returnType=StructType().add("place", IntegerType()).add("word", StringType()))
class WordsOf:
    """A row for each word between single spaces, with its place from 1."""

    def eval(self, text: str | None):
        for i, word in enumerate((text or "").split(" "), 1):
            if word:
                yield i, word
