"""Stemming token arrays without a shuffle.

An Arrow UDF stems the arrays of a batch: each distinct term of a slice of it
once, by a bounded table that lives as long as the Python worker; the tokens
themselves stay in Arrow's buffers, so a batch costs a few times its text and
not a Python object per token.  Rows stay where they are: no exchange, no id,
no hot keys.  The same function serves batch jobs and streams.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions.porter2 import stem

#: Distinct terms whose stems a worker remembers.
STEM_CACHE = 200_000
#: Rows whose distinct terms are held at a time.
SLICE_ROWS = 500


@lru_cache(maxsize=STEM_CACHE)
def cached_stem(term: str) -> str:
    return stem(term)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_arrays(arrays: pa.Array) -> pa.Array:
    """Porter2 stem of every token of every array (order, duplicates and NULLs stay)."""
    done, begin = [], 0
    while begin < len(arrays):
        rows = arrays.slice(begin, SLICE_ROWS)
        begin += len(rows)
        terms = rows.flatten().dictionary_encode()
        stems = pa.array([None if t is None else cached_stem(t) for t in terms.dictionary.to_pylist()], pa.string())
        lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        none = rows.is_null() if rows.null_count else None
        done.append(pa.ListArray.from_arrays(pa.array(offsets), stems.take(terms.indices), mask=none))
    return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.string()))


def stem_tokens(df: DataFrame, tokens_col: str, out_col: str) -> DataFrame:
    """Add ``out_col``: the stems of ``tokens_col``; an empty or NULL array stays empty or NULL."""
    return df.withColumn(out_col, stem_arrays(F.col(tokens_col)))
