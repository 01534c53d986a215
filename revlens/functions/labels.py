"""Label expressions: star rating -> binary class, class string -> number."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rating groups of the reference (1-3 negative, 4-5 positive).
NEGATIVE_SCORES = (1, 2, 3)
POSITIVE_SCORES = (4, 5)

# Class strings of the two pretrained sentiment heads.
IMDB_CLASS_MAP = {"neg": "0", "neutral": "0", "pos": "1"}
TWITTER_CLASS_MAP = {"negative": "0", "neutral": "0", "positive": "1"}


def binarize_score(c: Column | str) -> Column:
    """1,2,3 -> 0 and 4,5 -> 1; any other value passes unchanged (numeric columns)."""
    col = F.col(c) if isinstance(c, str) else c
    return (
        F.when(col.isin(*NEGATIVE_SCORES), F.lit(0.0))
        .when(col.isin(*POSITIVE_SCORES), F.lit(1.0))
        .otherwise(col)
    )


def map_class_labels(c: Column | str, mapping: Mapping[str, str] = IMDB_CLASS_MAP) -> Column:
    """Replace class strings by their numeric label and cast to double.

    Unmapped strings keep their value and become NULL unless numeric
    (``try_cast``; a plain cast raises under ANSI mode).
    """
    col = F.col(c) if isinstance(c, str) else c
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(lookup[col], col).try_cast("double")
