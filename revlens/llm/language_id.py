"""Language identification by Bayesian fusion of text, markup, address and host evidence.

1. *Text.*  A naive Bayes model of hashed byte trigrams gives the log-likelihood
   of every text in every declared language.  It is fitted on a bounded sample of rows
   with a declared language (``SAMPLE`` per language).  Declared tags count by
   their primary subtag (``en-GB`` is ``en``).  Neighbouring trigrams
   aren't independent, so the evidence is tempered: its weight stops growing
   after ``TEXT_GRAMS`` trigrams.
2. *Declared language* (markup) and *address suffix*: likelihood tables
   P(declared | language) and P(suffix | language), counted over all rows by
   the text's own decision and smoothed.
3. *Host prior*: shares of the languages per host, smoothed towards its
   domain, which is smoothed towards the suffix, and that towards the corpus;
   every level one grouped aggregation.

The posterior multiplies the four and sums to one over the languages.  A row
is rejected when no language is known well enough: no letters, text unlike
any language (its best log-likelihood per trigram is ``FLOOR`` standard
deviations from the sample's, more for short texts), or a best posterior under
``MIN_POSTERIOR``.

Memory: a task holds the counts of one slice of rows or one part of a long text.

Defined results: NULL, empty and letterless texts are rejected; texts too short
for a trigram are judged by the other evidence;
NULL declarations, addresses and hosts add none; rows that repeat an id are
judged one by one; without any declared row nothing is known and all rows are
rejected; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.shuffle_tools import join_weighted, written
from revlens.llm.text_kernel import LOWER, PART_BYTES, row_slices, text_bytes

SAMPLE = 400
#: Characters of a sampled text, at most.  Longer texts fill the sample, by their beginning, where shorter ones don't.
SAMPLE_CHARS = 20_000
BUCKETS = 1 << 15
TEXT_GRAMS = 200.0
#: Pseudo-counts that a level of the host prior gets from the level above.
PRIOR_STRENGTH = 20.0
#: Standard deviations below the usual mean log-likelihood at which a text is like no language.
FLOOR = -12.0
MIN_POSTERIOR = 0.5


def _grams(buf: np.ndarray) -> np.ndarray:
    """Hash bucket of the trigram that begins at each byte (letters only: other bytes become one space)."""
    low = LOWER[buf].astype(np.uint32)
    low[((low < 0x61) | (low > 0x7A)) & (low < 0x80)] = 0x20
    if len(low) < 3:
        return np.zeros(0, np.int64)
    key = low[:-2] | (low[1:-1] << 8) | (low[2:] << 16)
    return ((key * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)


_BLANK = _grams(np.full(3, 0x20, np.uint8))[0]


def _letter(buf: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a letter."""
    low = LOWER[buf]
    return ((low >= 0x61) & (low <= 0x7A)) | (low >= 0x80)


class TextModel:
    """Log-probabilities of trigram buckets per language, and the usual range of the best mean."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        counts = np.zeros((len(self.languages), BUCKETS))
        for i, name in enumerate(self.languages):
            for t in texts[name]:
                counts[i] += np.bincount(_grams(np.frombuffer(t.encode(), np.uint8)), minlength=BUCKETS)
        smooth = counts + 0.05 * (counts.sum(0) + 1) / (counts.sum() + BUCKETS) * BUCKETS
        self.table = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)
        by_gram = np.ascontiguousarray(self.table.T)
        best = [float(self._means(t, by_gram).max()) for name in self.languages for t in texts[name] if len(t) >= 200]
        self.usual, self.spread = (float(np.mean(best)), float(np.std(best)) + 0.05) if best else (0.0, 1e9)

    def _means(self, text: str, by_gram: np.ndarray) -> np.ndarray:
        g, times = np.unique(_grams(np.frombuffer(text.encode(), np.uint8)), return_counts=True)
        return times @ by_gram[g].astype(np.float64) / times.sum() if len(g) else np.full(len(self.languages), -1e9)

    def score(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed log-likelihood per row and language, trigrams that hold a letter, and letters (bytes) per row."""
        buf, offsets = text_bytes(column)
        n = len(offsets) - 1
        sums, grams, letters = np.zeros((n, len(self.languages))), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for lo, hi in row_slices(offsets):
            a, b = int(offsets[lo]), int(offsets[hi])
            if hi - lo > 1 or b - a <= PART_BYTES:
                sums[lo:hi], grams[lo:hi], letters[lo:hi] = self._sums(buf[a:b], offsets[lo:hi + 1] - a)
                continue
            for p in range(a, b, PART_BYTES):  # one long row: a trigram counts where it begins
                end = min(p + PART_BYTES, b)
                part = self._sums(buf[p:min(end + 2, b)], np.array([0, min(end + 2, b) - p]))
                sums[lo] += part[0][0]
                grams[lo] += part[1][0]
                letters[lo] += part[2][0] - _letter(buf[end:min(end + 2, b)]).sum()
        return sums, grams, letters

    def _sums(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``score`` of a few rows."""
        letter = np.append(0, np.cumsum(_letter(buf)))
        g = _grams(buf)
        start = offsets[:-1]
        size = np.maximum(np.diff(offsets) - 2, 0)  # trigrams inside the row
        inside = np.zeros(len(g) + 1, np.int64)
        np.add.at(inside, np.minimum(start[size > 0], len(g)), 1)
        np.add.at(inside, np.minimum((start + size)[size > 0], len(g)), -1)
        use = (np.cumsum(inside)[:-1] > 0) & (g != _BLANK)
        seen = np.append(0, np.cumsum(use))
        first, last = seen[np.minimum(start, len(g))], seen[np.minimum(start + size, len(g))]
        at = g[use]
        sums = np.zeros((len(start), len(self.languages)))
        for i in range(len(self.languages)):
            run = np.append(0.0, np.cumsum(self.table[i][at], dtype=np.float64))
            sums[:, i] = run[last] - run[first]
        return sums, last - first, letter[offsets[1:]] - letter[offsets[:-1]]


def primary_language(tag: Column) -> Column:
    """Lower-case primary subtag of a declared language; a tag that begins with a single letter (``x-``, ``i-``) stays whole."""
    whole = F.replace(F.lower(F.trim(tag)), F.lit("_"), F.lit("-"))
    first = F.split_part(whole, F.lit("-"), F.lit(1))
    return F.nullif(F.when(F.length(first) >= 2, first).otherwise(whole), F.lit(""))


def fit(rows: DataFrame) -> TextModel:
    """Model from rows ``text, declared``: of every declared language the ``SAMPLE`` first texts in a hash order, long ones last."""
    labelled = rows.select("text", primary_language(F.col("declared")).alias("declared")) \
        .where(F.col("declared").isNotNull() & (F.length("text") >= 1)) \
        .select("declared", "text", F.xxhash64("text").alias("h"), (F.length("text") > SAMPLE_CHARS).alias("long"))
    # different texts, of which the threshold takes a share
    names = labelled.groupBy("declared", "h", "long").agg(F.lit(1).alias("one")) \
        .groupBy("declared").agg(F.count_if(~F.col("long")).alias("short_kinds"), F.count_if("long").alias("long_kinds"))
    kinds = F.when(~F.col("long"), F.col("short_kinds")).when(F.col("short_kinds") < SAMPLE, F.col("long_kinds"))
    # one scan: about 4 SAMPLE different texts of each language by the size of their hash, then the first SAMPLE of those
    place = F.pmod("h", F.lit(1 << 40)) / F.lit(float(1 << 40))
    some = labelled.join(F.broadcast(names), "declared").where(place * kinds <= 4 * SAMPLE) \
        .select("declared", F.substring("text", 1, SAMPLE_CHARS).alias("text"), "long", place.alias("place")).distinct()
    first = Window.partitionBy("declared").orderBy("long", "place", "text")
    picked = some.withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE).select("declared", "text").collect()
    texts: dict[str, list[str]] = {}
    for r in picked:
        texts.setdefault(r["declared"], []).append(r["text"])
    return TextModel({n: sorted(t) for n, t in texts.items()})


def _levels(rows: DataFrame, n: int) -> DataFrame:
    """Smoothed language shares of each host: corpus, suffix, domain, host."""
    sums = [F.sum(F.col("share")[i]).alias(f"s{i}") for i in range(n)]
    hosts = rows.groupBy("host", "domain", "suffix").agg(F.count("*").alias("w"), *sums)
    # the total is held as a column, so that expressions don't grow with the square of the number of languages
    hosts = written(hosts.withColumn("total", sum(F.col(f"s{i}") for i in range(n))), "lang-hosts")

    def smoothed(df):
        mixed = [(F.col(f"s{i}") + PRIOR_STRENGTH * F.col("above")[i]) / (F.col("total") + PRIOR_STRENGTH) for i in range(n)]
        return F.array(*mixed)
    up = [F.sum(c).alias(c) for c in (*[f"s{i}" for i in range(n)], "total")]
    corpus = hosts.agg(*up)
    corpus = corpus.select(F.array(*[(F.coalesce(f"s{i}", F.lit(0.0)) + 1) / (F.coalesce("total", F.lit(0.0)) + n) for i in range(n)]).alias("above"))
    suffix = hosts.groupBy("suffix").agg(F.count("*").alias("w"), *up).join(F.broadcast(corpus))
    suffix = written(suffix.select("suffix", "w", smoothed(suffix).alias("above")), "lang-suffixes")
    domain = join_weighted(hosts.groupBy("domain", "suffix").agg(F.count("*").alias("hosts"), *up), suffix, ["suffix"], "w", "inner").drop("w")
    domain = written(domain.select("domain", "suffix", F.col("hosts").alias("w"), smoothed(domain).alias("above")), "lang-domains")
    host = join_weighted(hosts.withColumnRenamed("w", "pages"), domain, ["domain", "suffix"], "w", "inner")
    return written(host.select("host", "domain", "suffix", F.col("pages").alias("w"), smoothed(host).alias("prior")), "lang-priors")


def _table(rows: DataFrame, column: str, n: int) -> DataFrame:
    """log P(value | language) of a column's values, counted over all rows, smoothed; NULL adds nothing."""
    seen = rows.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count("*").alias("w"), *[F.sum(F.col("share")[i]).alias(f"s{i}") for i in range(n)])
    seen = written(seen, "lang-table")
    sums = seen.agg(F.count("*").alias("kinds"), *[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"t{i}") for i in range(n)])
    logs = [F.log((F.col(f"s{i}") + 0.5) / (F.col(f"t{i}") + 0.5 * F.col("kinds"))) for i in range(n)]
    return seen.join(F.broadcast(sums)).select(column, "w", F.array(*logs).alias(f"{column}_log"))


def identify(rows: DataFrame, model: TextModel | None = None) -> DataFrame:
    """``key, language, posterior, per_gram, accepted`` for rows ``key, text, declared, suffix, domain, host``.

    ``key`` may be of any type; ``language`` is NULL where nothing is known.
    """
    spark = rows.sparkSession
    rows = rows.select("key", *[F.col(c).cast("string").alias(c) for c in ("text", "declared", "suffix", "domain", "host")]) \
        .withColumn("declared", primary_language(F.col("declared")))
    model = model or fit(rows)
    n = len(model.languages)
    if not n:
        return rows.select("key", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"),
                           F.lit(None).cast("double").alias("per_gram"), F.lit(False).alias("accepted"))
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            sums, grams, letters = held.value.score(batch.column("text"))
            # tempered: beyond TEXT_GRAMS trigrams the mean counts, not the sum
            weight = np.minimum(1.0, TEXT_GRAMS / np.maximum(grams, 1)) * 0.25
            logs = sums * weight[:, None]
            top = logs.max(1)
            share = np.exp(logs - top[:, None])
            share /= share.sum(1, keepdims=True)
            per_gram = np.where(grams > 0, sums.max(1) / np.maximum(grams, 1), np.nan)
            offsets = pa.array(np.arange(0, (len(grams) + 1) * n, n, dtype=np.int32))
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(grams), pa.array(letters), pa.array(per_gram, mask=grams == 0),
                 pa.ListArray.from_arrays(offsets, pa.array((logs - top[:, None]).ravel())), pa.ListArray.from_arrays(offsets, pa.array(share.ravel()))],
                names=[*keep, "grams", "letters", "per_gram", "text_log", "share"])
    key_type = rows.schema["key"].dataType.simpleString()
    scored = written(rows.mapInArrow(run, f"key {key_type}, declared string, suffix string, domain string, host string, "
                                          "grams long, letters long, per_gram double, text_log array<double>, share array<double>"), "lang-scored")
    # rows without text evidence don't vote
    voting = scored.where("grams > 0").withColumn("host", F.coalesce("host", F.lit(""))) \
        .withColumn("domain", F.coalesce("domain", F.lit(""))).withColumn("suffix", F.coalesce("suffix", F.lit("")))
    priors = _levels(voting, n)
    out = scored.withColumn("host_key", F.coalesce("host", F.lit(""))).withColumn("domain_key", F.coalesce("domain", F.lit(""))) \
        .withColumn("suffix_key", F.coalesce("suffix", F.lit("")))
    out = written(out.drop("share", "host", "domain"), "lang-keys")
    priors = priors.toDF("host_key", "domain_key", "suffix_key", "w", "prior")
    out = written(join_weighted(out, priors, ["host_key", "domain_key", "suffix_key"], "w", "left").drop("w"), "lang-with-host")
    for column in ("declared", "suffix"):
        table = written(_table(scored.where("grams > 0"), column, n), "lang-table")
        out = written(join_weighted(out, table, [column], "w", "left").drop("w"), "lang-joined")
    total = [F.col("text_log")[i] + F.coalesce(F.log(F.col("prior")[i]), F.lit(0.0)) + F.coalesce(F.col("declared_log")[i], F.lit(0.0))
             + F.coalesce(F.col("suffix_log")[i], F.lit(0.0)) for i in range(n)]
    names = F.array(*[F.lit(x) for x in model.languages])
    out = out.withColumn("total", F.array(*total)).withColumn("top", F.array_max("total"))
    posterior = 1 / F.aggregate(F.col("total"), F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    known = F.col("letters") > 0
    # short texts vary more
    floor = model.usual + FLOOR * model.spread * F.sqrt(F.greatest(F.lit(1.0), TEXT_GRAMS / F.col("grams")))
    return out.select("key", F.when(known, F.element_at(names, F.array_position("total", F.col("top")).cast("int"))).alias("language"),
                      F.when(known, posterior).otherwise(0.0).alias("posterior"), "per_gram",
                      (known & (posterior >= MIN_POSTERIOR) & F.coalesce(F.col("per_gram") >= floor, F.lit(True))).alias("accepted"))


def identify_documents(docs: DataFrame) -> DataFrame:
    """``identify`` for documents: the declared language is ``lang``, the host ``source`` (its own domain)."""
    source = F.col("source").cast("string")
    return identify(docs.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("declared"), F.lit(None).alias("suffix"),
                                source.alias("domain"), source.alias("host")))


def markup_language(html: Column) -> Column:
    """Primary subtag of the ``lang`` attribute of the first ``<html>`` tag, lower-cased; NULL if none."""
    found = F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)
    return F.when(found != "", F.lower(found))


def markup_text(html: Column) -> Column:
    """Text between tags; scripts, styles and comments go."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*>", " ")
