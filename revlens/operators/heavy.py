"""Vocabularies of heavy hitters: the top terms without shuffling every distinct term.

``termstats.vocabulary`` counts all distinct terms; of n-grams nearly all are
rare, and their counts are shuffled only to be thrown away.  Here:

1. every task keeps a frequent-items sketch of its terms, the sketches of a
   group of tasks are combined, then those of the groups; what moves is one
   sketch of at most ``tracked`` terms per task;
2. the sketch names candidates; a second pass counts just those, exactly (at
   most ``candidates`` of them, broadcast);
3. a bound proves the result.  A term that the sketch does not name occurs at
   most ``7 n tracked_error`` times, or at most as often as the last named one's
   estimate where the list was cut, and never more often than all terms less the
   exactly counted ones.  If place ``size`` has a higher exact count, no other
   term belongs to the top.

Where the bound does not separate place ``size`` from the rest (a flat
distribution, or too few terms tracked) the result comes from the full count
instead, so it is exact in every case.  Estimates are never below the exact
counts: if already place ``size`` of them is within the bound, the second pass
is left out.  The terms are read up to three times: pass a table, not a long plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.operators.termstats import explode_with_pos, vocabulary
from revlens.session import scratch_path

#: Terms a sketch tracks, and groups of tasks whose sketches are combined first.
TRACKED, GROUPS = 200_000, 64
#: A sketch of m counters is off by at most 3.5 / m of all counted items.
SKETCH_ERROR = 3.5


@dataclass
class HeavyVocabulary:
    """``table`` (term, idx, cf); whether the bound proved it; the bound on the count of every other term."""

    table: DataFrame
    proved: bool
    bound: float


def heavy_vocabulary(df: DataFrame, tokens_col: str, size: int, term_col: str = "term", tracked: int = TRACKED) -> HeavyVocabulary:
    """The top ``size`` terms by corpus count, ties by term, as ``termstats.vocabulary`` gives them.

    NULL arrays and NULL terms count as none; no terms give an empty vocabulary.
    """
    candidates = min(2 * size, tracked, 100_000)
    if candidates < size:
        return HeavyVocabulary(vocabulary(_without_nulls(df, tokens_col), tokens_col, size, term_col), False, float("inf"))
    terms = explode_with_pos(df, tokens_col, [], "_pos", term_col).where(F.col(term_col).isNotNull()).select(term_col)
    group = F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("g")
    sketch = terms.select(group, term_col).groupBy("g") \
        .agg(F.expr(f"approx_top_k_accumulate(`{term_col}`, {tracked})").alias("s"), F.count("*").alias("n")) \
        .groupBy(F.lit(1).alias("one")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"), F.sum("n").alias("n"))
    named = sketch.where("n > 0").select("n", F.expr(f"approx_top_k_estimate(s, {candidates})").alias("top"))
    path = scratch_path(df.sparkSession, "heavy-candidates")  # read twice: as a list and for its bound
    named.write.parquet(path)
    named = df.sparkSession.read.schema(named.schema).parquet(path)
    facts = named.select("n", F.size("top").alias("k"), F.array_min("top.count").alias("least"),
                         F.get(F.sort_array("top.count", asc=False), F.lit(size - 1)).alias("place"),
                         F.aggregate("top.count", F.lit(0).cast("long"), lambda a, x: a + x).alias("named")).first()
    order = [F.desc("cf"), F.asc(term_col)]
    bound, rest = 0.0, 0
    if facts is not None:
        # counters are 4/3 of the tracked terms at least; the sketch leaves out what may be twice its error
        bound = 2 * SKETCH_ERROR * facts["n"] / (tracked / 0.75)
        bound = max(bound if bound >= 1 else 0.0, facts["least"] if facts["k"] == candidates else 0.0)
        rest = facts["n"] - facts["named"]
        if min(bound, rest) >= max(facts["place"] or 0, 1):  # the exact counts cannot be above the bound
            return HeavyVocabulary(vocabulary(_without_nulls(df, tokens_col), tokens_col, size, term_col), False, bound)
    wanted = named.select(F.explode("top.item").alias(term_col))
    counted = terms.join(F.broadcast(wanted), term_col).groupBy(term_col).agg(F.count(F.lit(1)).alias("cf"))
    counted_path = scratch_path(df.sparkSession, "heavy-counted")
    counted.write.parquet(counted_path)
    counted = df.sparkSession.read.schema(counted.schema).parquet(counted_path)
    top = counted.orderBy(*order).limit(size)
    if facts is None:  # no terms
        return HeavyVocabulary(_numbered(top, order, term_col), True, 0.0)
    bound = min(bound, float(facts["n"] - (counted.agg(F.sum("cf")).first()[0] or 0)))
    found = top.agg(F.count("*").alias("k"), F.min("cf").alias("cf")).first()
    if bound == 0 or (found["k"] == size and found["cf"] > bound):
        return HeavyVocabulary(_numbered(top, order, term_col), True, bound)
    return HeavyVocabulary(vocabulary(_without_nulls(df, tokens_col), tokens_col, size, term_col), False, bound)


def _without_nulls(df: DataFrame, tokens_col: str) -> DataFrame:
    return df.withColumn(tokens_col, F.filter(tokens_col, lambda t: t.isNotNull()))


def _numbered(top: DataFrame, order: list, term_col: str) -> DataFrame:
    return top.select(term_col, (F.row_number().over(Window.orderBy(*order)) - 1).alias("idx"), "cf")
