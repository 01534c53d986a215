"""Registered queries of the training-data operators, with their SQL where it exists.

Every query is thin: it reads its tables, applies the operator of its module
with production parameters and derives the columns asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.collocations import collocations
from revlens.llm.decontaminate import decontaminate
from revlens.llm.digest_index import deduplicate
from revlens.llm.huffman import round_trip
from revlens.llm.language_id import identify, identify_documents, markup_language, markup_text
from revlens.llm.license_rules import license_report
from revlens.llm.minhash import near_duplicates
from revlens.llm.packing import pack_documents
from revlens.llm.periodic_runs import run_report, with_planted_period
from revlens.llm.rp_forest import nearest
from revlens.llm.secret_crf import secret_report
from revlens.llm.suffix_dedup import remove_repeats
from revlens.llm.url_reputation import BOUND_Z, MAX_BAD, STRENGTH, domain_of, host_of, judge_urls, suffix_of
from revlens.session import scratch_path
from revlens.sources.tables import read_table


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file on this machine (the package is installed on every node)."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"])


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages``: rule and verdict.

    Stand-in for page outcomes: a row of ``labels`` is the outcome of the page
    with that id, bad when it is toxic or of no quality.
    """
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return judge_urls(read_table(spark, sf_dir, "pages", ["page_id", "url"]), outcomes) \
        .select("page_id", "host", "path", "rule", "verdict")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections in all ``documents``."""
    return license_report(_documents(spark, sf_dir))


def op3_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all ``documents`` written as Huffman-coded segments and read back."""
    return round_trip(_documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), drops_space=False, end_id=0)


def op4_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``: fixed patterns and the random field's spans."""
    return secret_report(_documents(spark, sf_dir))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all ``documents`` covered by 13-word windows of ``benchmark``."""
    return decontaminate(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def op6_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every 100th of ``embeddings`` among all others."""
    return nearest(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all ``documents`` from text, declared language and source, and whether it is known well enough."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return identify_documents(docs).withColumnRenamed("key", "doc_id").select("doc_id", "language", "posterior", "accepted")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all ``pages`` from text, the markup's ``lang`` attribute, the address suffix and host."""
    host = host_of(F.col("url"))
    rows = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]).select(
        F.col("page_id").alias("key"), markup_text(F.col("html")).alias("text"), markup_language(F.col("html")).alias("declared"),
        suffix_of(host).alias("suffix"), domain_of(host).alias("domain"), host.alias("host"))
    return identify(rows).withColumnRenamed("key", "page_id").select("page_id", "language", "posterior", "accepted")


def corpus_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py`` over all ``documents``."""
    import corpus_pipeline as stages
    return stages.run(spark, sf_dir)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all ``documents`` left after removing repeated 400-byte strings; a cut inside a character leaves U+FFFD in the text."""
    return remove_repeats(_documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents`` on four-word shingles at 0.8."""
    return near_duplicates(_documents(spark, sf_dir), shingle_words=4)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 4096 tokens."""
    return pack_documents(_documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), drops_space=True, end_id=1)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language of all ``documents``."""
    return collocations(read_table(spark, sf_dir, "documents", ["lang", "text"]))


def op12_digest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts in all ``documents``, through a new digest index."""
    return deduplicate(_documents(spark, sf_dir), scratch_path(spark, "digest-index")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of periodically repeated words in all ``documents``, a tenth of them with a planted period."""
    return run_report(with_planted_period(_documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_reputation": op1_url_reputation,
    "op2_license_scan": op2_license_scan,
    "op3_huffman_tokens": op3_huffman_tokens,
    "op4_secret_crf": op4_secret_crf,
    "op5_decontaminate": op5_decontaminate,
    "op6_rp_forest": op6_rp_forest,
    "op7_language_id": op7_language_id,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_minhash": op9_minhash,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_digest_dedup": op12_digest_dedup,
    "op13_periodic_runs": op13_periodic_runs,
    "language_id_pages": language_id_pages,
    "pipeline": corpus_pipeline,
}

def _shrunk(source: str, mean: str) -> str:
    """SQL of one level: posterior mean (and pseudo-counts) of source(bad, n, prior, ...)."""
    low, high = 1 / (STRENGTH[1] + 1), 1 / (STRENGTH[0] + 1)
    strength = (f"(SELECT 1 / least(greatest(coalesce(CASE WHEN sum(n * prior * (1 - prior) * (n - 1)) > 0 "
                f"THEN sum(power(bad - n * prior, 2) - n * prior * (1 - prior)) / sum(n * prior * (1 - prior) * (n - 1)) END, 1.0), "
                f"{low!r}), {high!r}) - 1 FROM {source})")
    return (f"SELECT *, s * prior + bad AS a, s * (1 - prior) + n - bad AS b, (s * prior + bad) / (s + n) AS {mean} "
            f"FROM (SELECT *, {strength} AS s FROM {source})")


#: The hosts of ``pages`` are plain names, so the last two labels are the registered domain.
OP1_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
seen AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
hosts AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad, regexp_extract(host, '[^.]*[.]?[^.]*$', 0) AS domain,
  regexp_extract(host, '[^.]*$', 0) AS suffix FROM urls LEFT JOIN seen USING (page_id) GROUP BY host),
suffixes0 AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM hosts) AS prior FROM hosts GROUP BY suffix),
suffixes AS ({_shrunk("suffixes0", "mean")}),
domains0 AS (SELECT d.domain, d.suffix, d.bad, d.n, s.mean AS prior FROM (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY domain, suffix) d JOIN suffixes s ON d.suffix = s.suffix),
domains AS ({_shrunk("domains0", "mean")}),
hosts0 AS (SELECT h.host, h.n, h.bad, d.mean AS prior FROM hosts h JOIN domains d ON h.domain = d.domain AND h.suffix = d.suffix),
posterior AS ({_shrunk("hosts0", "mean")}),
judged AS (SELECT u.page_id, u.host, u.path, CASE
  WHEN (u.host = 'example.net' OR u.host LIKE '%.example.net') AND starts_with(u.path, '/en/') THEN 'example.net/en/'
  WHEN (u.host = 'example.com' OR u.host LIKE '%.example.com') AND starts_with(u.path, '/de/') THEN 'example.com/de/'
  WHEN (u.host = 'org' OR u.host LIKE '%.org') AND starts_with(u.path, '/fr/') THEN 'org/fr/'
  WHEN (u.host = 'net' OR u.host LIKE '%.net') AND starts_with(u.path, '/') THEN 'net/' END AS rule,
  p.mean - {BOUND_Z} * sqrt(p.a * p.b / ((p.a + p.b) * (p.a + p.b) * (p.a + p.b + 1))) AS lower_bound
  FROM urls u JOIN posterior p ON u.host = p.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN lower_bound > {MAX_BAD} THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""

#: Words of a piece stand in consecutive rows; a phrase of k words is a row and the k - 1 after it in its piece.
OP11_SQL = """
WITH pieces AS (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
lists AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
    FROM (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS k FROM lists))),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
f AS (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY lang, k, g HAVING count(*) >= 100),
inside AS (SELECT lang, k - 1 AS k, g[1:k - 1] AS g, a FROM f WHERE k > 2 UNION SELECT lang, k - 1, g[2:k], a FROM f WHERE k > 2),
kept AS (SELECT * FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = f.lang AND i.k = f.k AND i.g = f.g AND i.a >= f.a)),
cuts AS (SELECT c.*, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) c JOIN n ON n.lang = c.lang
    JOIN f l ON l.lang = c.lang AND l.k = c.j AND l.g = c.g[1:c.j]
    JOIN f r ON r.lang = c.lang AND r.k = c.k - c.j AND r.g = c.g[c.j + 1:c.k]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
    array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM lowest) WHERE rank <= 2000
"""

OP12_SQL = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
    row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

ORACLE_SQL: dict[str, str] = {"op1_url_reputation": OP1_SQL, "op11_collocations": OP11_SQL, "op12_digest_dedup": OP12_SQL}
