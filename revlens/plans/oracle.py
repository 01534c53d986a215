"""DuckDB SQL that computes the same relations as ``revlens.plans.catalog``.

Used only as the correctness oracle: tables ``documents labels events`` are
views over the same parquet files.  Shared pieces are SQL fragments so each
query reads as one WITH statement.
"""

from __future__ import annotations

from revlens.functions.stopwords import sql_list_literal
from revlens.plans.relational import NGRAM_MIN_DOC_FREQ, NGRAM_VOCAB_SIZES, VOCAB_SIZE

SW = sql_list_literal()

CLEAN = r"lower(regexp_replace({x}, '[^a-zA-Z\s]', '', 'g'))"
TOKENS = (r"CASE WHEN {c} = '' THEN [''] WHEN regexp_full_match({c}, '\s+') THEN []::VARCHAR[] "
          r"ELSE string_split_regex(regexp_replace({c}, '\s+$', ''), '\s') END")
WORDS = "list_filter({t}, lambda w: NOT list_contains(" + SW + ", lower(w)))"
BUCKET = "(('0x' || substr(md5(CAST({id} AS VARCHAR)), 1, 8))::BIGINT)"
SPLIT = "CASE WHEN " + BUCKET + " % 10 = 0 THEN 'test' ELSE 'train' END"
BIGRAMS = ("CASE WHEN len({w}) >= 2 THEN list_transform(range(1, len({w})), "
           "lambda i: {w}[i] || ' ' || {w}[i + 1]) ELSE []::VARCHAR[] END")


def _doc_words() -> str:
    return f"""
doc_clean AS (SELECT doc_id, {CLEAN.format(x='text')} AS c FROM documents WHERE text IS NOT NULL),
doc_tok AS (SELECT doc_id, {TOKENS.format(c='c')} AS tokens FROM doc_clean),
doc_words AS (SELECT doc_id, tokens, {WORDS.format(t='tokens')} AS words FROM doc_tok)"""


def _corpus() -> str:
    return f"""
lab AS (SELECT d.doc_id, CAST(l.quality AS DOUBLE) AS label, {CLEAN.format(x='d.text')} AS c
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL AND l.quality IS NOT NULL),
lab_tok AS (SELECT doc_id, label, {TOKENS.format(c='c')} AS tokens FROM lab),
corp AS (SELECT doc_id, label, {SPLIT.format(id='doc_id')} AS split, tokens,
                {WORDS.format(t='tokens')} AS words FROM lab_tok)"""


def _review_corpus() -> str:
    """The corpus of the review CSV job: labels from ratings 1..5, others rejected."""
    return f"""
lab AS (SELECT doc_id, CASE WHEN 1 + {BUCKET.format(id='doc_id')} % 5 <= 3 THEN 0.0 ELSE 1.0 END::DOUBLE AS label,
               {CLEAN.format(x='text')} AS c FROM documents WHERE text IS NOT NULL AND doc_id % 13 <> 0),
lab_tok AS (SELECT doc_id, label, {TOKENS.format(c='c')} AS tokens FROM lab),
corp AS (SELECT doc_id, label, {SPLIT.format(id='doc_id')} AS split, tokens,
                {WORDS.format(t='tokens')} AS words FROM lab_tok)"""


def _reviews() -> str:
    return f"""
reviews AS (SELECT doc_id, CAST(1 + {BUCKET.format(id='doc_id')} % 5 AS DOUBLE) AS score, text FROM documents)"""


def _annotations() -> str:
    return """
ann AS (SELECT event_id,
               CASE WHEN event_type = 'view' THEN []::VARCHAR[]
                    ELSE [CASE WHEN event_type IN ('purchase', 'signup') THEN 'pos'
                               WHEN event_type = 'error' THEN 'neg' ELSE 'neutral' END] END AS results
        FROM events),
ann_x AS (SELECT event_id, unnest(results) AS prediction FROM ann)"""


def _explode(src: str, id_col: str, arr: str, out: str) -> str:
    return (f"SELECT {id_col}, CAST(unnest(generate_series(0, len({arr}) - 1)) AS INTEGER) AS pos, "
            f"unnest({arr}) AS {out} FROM {src}")


def _tf(src: str, arr: str, carry: str = "") -> str:
    c = f"{carry}, " if carry else ""
    return (f"SELECT doc_id, {c}term, count(*) AS tf FROM "
            f"(SELECT doc_id, {c}unnest({arr}) AS term FROM {src}) GROUP BY ALL")


def _vocab(tf_src: str, size: int) -> str:
    return (f"SELECT term, idx, cf FROM (SELECT term, cf, CAST(row_number() OVER (ORDER BY cf DESC, term) - 1 AS INTEGER) AS idx "
            f"FROM (SELECT term, CAST(sum(tf) AS BIGINT) AS cf FROM {tf_src} GROUP BY term)) WHERE idx < {size}")


def _nb(features: str, train_docs: str, v_expr: str, test_features: str, test_docs: str) -> str:
    """NB fit + score; ``features`` (doc_id, label, idx, value)."""
    return f"""
nb_classes AS (SELECT label, count(*) AS n_c FROM {train_docs} GROUP BY label),
nb_sums AS (SELECT label, idx, sum(value) AS n_ct FROM {features} GROUP BY label, idx),
nb_tot AS (SELECT label, sum(n_ct) AS tot FROM nb_sums GROUP BY label),
nb_prior AS (SELECT c.label,
                    ln(c.n_c + 1.0) - ln((SELECT count(*) FROM {train_docs}) + (SELECT count(*) FROM nb_classes) * 1.0) AS pi,
                    ln(1.0) - ln(coalesce(t.tot, 0) + ({v_expr}) * 1.0) AS theta0,
                    coalesce(t.tot, 0) AS tot
             FROM nb_classes c LEFT JOIN nb_tot t ON c.label = t.label),
nb_theta AS (SELECT s.label, s.idx, ln(s.n_ct + 1.0) - ln(p.tot + ({v_expr}) * 1.0) AS theta
             FROM nb_sums s JOIN nb_prior p ON s.label = p.label),
nb_contrib AS (SELECT f.doc_id, p.label, sum(f.value * coalesce(t.theta, p.theta0)) AS s
               FROM {test_features} f CROSS JOIN nb_prior p
               LEFT JOIN nb_theta t ON t.label = p.label AND t.idx = f.idx
               GROUP BY f.doc_id, p.label),
nb_scores AS (SELECT d.doc_id, p.label, p.pi + coalesce(c.s, 0) AS score
              FROM {test_docs} d CROSS JOIN nb_prior p
              LEFT JOIN nb_contrib c ON c.doc_id = d.doc_id AND c.label = p.label),
nb_pred AS (SELECT doc_id, label AS prediction, score FROM
              (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rk FROM nb_scores)
            WHERE rk = 1),
nb_out AS (SELECT p.doc_id, d.label, p.prediction, p.score FROM nb_pred p JOIN {test_docs} d ON p.doc_id = d.doc_id)"""


def _count_vector_nb(corpus: str | None = None) -> str:
    return f"""{corpus or _corpus()},
tf_train AS ({_tf("(SELECT * FROM corp WHERE split = 'train')", "words", "label")}),
vocab AS ({_vocab("tf_train", VOCAB_SIZE)}),
feat_train AS (SELECT doc_id, label, idx, tf AS value FROM tf_train JOIN vocab USING (term)),
train_docs AS (SELECT doc_id, label FROM corp WHERE split = 'train'),
test_docs AS (SELECT doc_id, label FROM corp WHERE split = 'test'),
tf_test AS ({_tf("(SELECT * FROM corp WHERE split = 'test')", "words")}),
feat_test AS (SELECT doc_id, idx, tf AS value FROM tf_test JOIN vocab USING (term)),
{_nb("feat_train", "train_docs", "SELECT count(*) FROM vocab", "feat_test", "test_docs")}"""


def _ngram_features() -> str:
    parts = [_corpus()]
    parts.append("n_train AS (SELECT count(*) AS m FROM corp WHERE split = 'train')")
    parts.append("g1 AS (SELECT doc_id, label, split, words AS grams FROM corp)")
    parts.append(f"g2 AS (SELECT doc_id, label, split, {BIGRAMS.format(w='words')} AS grams FROM corp)")
    for n in (1, 2):
        parts.append(f"tf{n} AS ({_tf(f'g{n}', 'grams', 'label, split')})")
        parts.append(f"voc{n} AS ({_vocab(f'(SELECT * FROM tf{n} WHERE split = {chr(39)}train{chr(39)})', NGRAM_VOCAB_SIZES[n - 1])})")
        parts.append(f"cnt{n} AS (SELECT doc_id, label, split, idx, tf FROM tf{n} JOIN voc{n} USING (term))")
        parts.append(f"idf{n} AS (SELECT idx, CASE WHEN count(*) >= {NGRAM_MIN_DOC_FREQ[n - 1]} "
                     f"THEN ln(((SELECT m FROM n_train) + 1.0) / (count(*) + 1.0)) ELSE 0.0 END AS idf "
                     f"FROM cnt{n} WHERE split = 'train' GROUP BY idx)")
        parts.append(f"sc{n} AS (SELECT doc_id, label, split, idx, tf * idf AS value FROM cnt{n} JOIN idf{n} USING (idx))")
    parts.append("feat AS (SELECT doc_id, label, split, idx, value FROM sc1 UNION ALL "
                 "SELECT doc_id, label, split, idx + (SELECT count(*) FROM voc1), value FROM sc2)")
    return ",\n".join(parts)


def _ngram_nb() -> str:
    return f"""{_ngram_features()},
train_docs AS (SELECT doc_id, label FROM corp WHERE split = 'train'),
test_docs AS (SELECT doc_id, label FROM corp WHERE split = 'test'),
feat_train AS (SELECT doc_id, label, idx, value FROM feat WHERE split = 'train'),
feat_test AS (SELECT doc_id, idx, value FROM feat WHERE split = 'test'),
{_nb("feat_train", "train_docs", "SELECT (SELECT count(*) FROM voc1) + (SELECT count(*) FROM voc2)", "feat_test", "test_docs")}"""


def _metrics() -> str:
    return f"""{_count_vector_nb()},
cm AS (SELECT label, prediction, count(*) AS n FROM nb_out GROUP BY label, prediction),
sup AS (SELECT label, sum(n) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp FROM cm GROUP BY label),
npred AS (SELECT prediction AS label, sum(n) AS npred FROM cm GROUP BY prediction),
per AS (SELECT s.label, s.support, s.tp, 2.0 * s.tp / (s.support + coalesce(p.npred, 0)) AS f1l
        FROM sup s LEFT JOIN npred p ON s.label = p.label),
met AS (SELECT CAST(sum(support) AS BIGINT) AS n, sum(tp) / sum(support) AS accuracy,
               sum(support * f1l) / sum(support) AS f1 FROM per)"""


ORACLE_SQL = {
    "clean_text": f"SELECT doc_id, {CLEAN.format(x='text')} AS text FROM documents",
    "drop_null_reviews": f"WITH {_reviews()} SELECT doc_id, score, {CLEAN.format(x='text')} AS text "
                         "FROM reviews WHERE score IS NOT NULL AND text IS NOT NULL AND doc_id % 17 <> 0 AND doc_id % 19 <> 0",
    "binarize_score": f"""WITH {_reviews()}
SELECT doc_id, score, CASE WHEN score IN (1, 2, 3) THEN 0.0 WHEN score IN (4, 5) THEN 1.0 ELSE score END AS label
FROM reviews WHERE score IS NOT NULL AND text IS NOT NULL""",
    "hash_split": f"SELECT doc_id, {SPLIT.format(id='doc_id')} AS split FROM documents",
    "label_balance": f"WITH {_corpus()} SELECT split, label, count(*) AS n FROM corp GROUP BY split, label",
    "explode_annotations": f"WITH {_annotations()} SELECT event_id, prediction FROM ann_x",
    "distinct_predictions": f"WITH {_annotations()} SELECT DISTINCT prediction FROM ann_x",
    "map_class_labels": f"""WITH {_annotations()}
SELECT event_id, TRY_CAST(CASE prediction WHEN 'neg' THEN '0' WHEN 'neutral' THEN '0' WHEN 'pos' THEN '1'
                                  ELSE prediction END AS DOUBLE) AS prediction FROM ann_x""",
    "map_class_labels_second": f"""WITH {_annotations()}
SELECT event_id, CASE results[1] WHEN 'neg' THEN 0.0 WHEN 'neutral' THEN 0.0 WHEN 'pos' THEN 1.0 END AS prediction FROM ann""",
    "tokenize": f"WITH {_doc_words()} {_explode('doc_tok', 'doc_id', 'tokens', 'token')}",
    "remove_stopwords": f"WITH {_doc_words()} SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, "
                        "CAST(len(words) AS INTEGER) AS n_words FROM doc_words",
    "token_stream": f"WITH {_doc_words()} {_explode('doc_words', 'doc_id', 'words', 'term')}",
    "filter_short_tokens": f"""WITH {_doc_words()},
kept AS (SELECT doc_id, list_filter(words, lambda w: length(w) >= 3) AS kept FROM doc_words)
{_explode('kept', 'doc_id', 'kept', 'term')}""",
    "ngrams_1": f"WITH {_doc_words()} {_explode('doc_words', 'doc_id', 'words', 'gram')}",
    "ngrams_2": f"""WITH {_doc_words()},
bi AS (SELECT doc_id, {BIGRAMS.format(w='words')} AS grams FROM doc_words)
{_explode('bi', 'doc_id', 'grams', 'gram')}""",
    "term_frequency": f"WITH {_doc_words()} {_tf('doc_words', 'words')}",
    "corpus_frequency": f"WITH {_doc_words()}, tf AS ({_tf('doc_words', 'words')}) "
                        "SELECT term, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term",
    "document_frequency": f"WITH {_doc_words()}, tf AS ({_tf('doc_words', 'words')}) "
                          "SELECT term, count(*) AS df FROM tf GROUP BY term",
    "vocab_topk": f"""WITH {_corpus()},
tf_train AS ({_tf("(SELECT * FROM corp WHERE split = 'train')", "words")})
{_vocab("tf_train", VOCAB_SIZE)}""",
    "vocab_heavy_hitters": f"""WITH {_doc_words()}, bi AS (SELECT doc_id, {BIGRAMS.format(w='words')} AS grams FROM doc_words),
tf1 AS ({_tf('doc_words', 'words')}), tf2 AS ({_tf('bi', 'grams')}),
v1 AS ({_vocab('tf1', NGRAM_VOCAB_SIZES[0])}), v2 AS ({_vocab('tf2', NGRAM_VOCAB_SIZES[1])})
SELECT 1 AS n, term, idx, cf FROM v1 UNION ALL SELECT 2, term, idx, cf FROM v2""",
    "idf_weights": f"""WITH {_doc_words()}, tf AS ({_tf('doc_words', 'words')})
SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM doc_words) + 1.0) / (count(*) + 1.0)), 6) AS idf
FROM tf GROUP BY term""",
    "idf_weights_mindf": f"""WITH {_doc_words()}, tf AS ({_tf('doc_words', 'words')})
SELECT term, count(*) AS df,
       round(CASE WHEN count(*) >= 50 THEN ln(((SELECT count(*) FROM doc_words) + 1.0) / (count(*) + 1.0)) ELSE 0.0 END, 6) AS idf
FROM tf GROUP BY term""",
    "tfidf_long": f"""WITH {_doc_words()}, tf AS ({_tf('doc_words', 'words')}),
idf AS (SELECT term, ln(((SELECT count(*) FROM doc_words) + 1.0) / (count(*) + 1.0)) AS idf FROM tf GROUP BY term)
SELECT doc_id, term, tf, round(tf * idf, 6) AS tfidf FROM tf JOIN idf USING (term)""",
    "count_vector_long": f"""WITH {_corpus()},
tf AS ({_tf("corp", "words", "split")}),
vocab AS ({_vocab("(SELECT * FROM tf WHERE split = 'train')", VOCAB_SIZE)})
SELECT doc_id, idx, tf FROM tf JOIN vocab USING (term)""",
    "assemble_ngram_features": f"WITH {_ngram_features()} "
                               "SELECT doc_id, CAST(idx AS INTEGER) AS idx, round(value, 6) AS value FROM feat",
    "nb_prior": f"WITH {_count_vector_nb()} SELECT label, round(pi, 6) AS pi, round(theta0, 6) AS theta0 FROM nb_prior",
    "nb_model": f"WITH {_count_vector_nb()} SELECT label, idx, round(theta, 6) AS theta FROM nb_theta",
    "nb_predict": f"WITH {_count_vector_nb()} SELECT doc_id, label, prediction, round(score, 6) AS score FROM nb_out",
    "ngram_nb_predict": f"WITH {_ngram_nb()} SELECT doc_id, label, prediction, round(score, 6) AS score FROM nb_out",
    "confusion_matrix": f"WITH {_count_vector_nb()} SELECT label, prediction, count(*) AS n FROM nb_out GROUP BY ALL",
    "eval_accuracy": f"WITH {_metrics()} SELECT n, round(accuracy, 6) AS accuracy FROM met",
    "eval_f1_weighted": f"WITH {_metrics()} SELECT n, round(f1, 6) AS f1 FROM met",
    "nb_incremental": f"WITH {_count_vector_nb()} SELECT label, idx, round(theta, 6) AS theta FROM nb_theta",
    "nb_tables_predict": f"WITH {_count_vector_nb()} SELECT doc_id, label, prediction, round(score, 6) AS score FROM nb_out",
    "write_with_metrics": f"WITH {_metrics()} SELECT 'nb' AS model, n, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM met",
    "csv_roundtrip": f"WITH {_reviews()} SELECT doc_id, score, text FROM reviews "
                     "WHERE score IS NOT NULL AND text IS NOT NULL",
    "text_scan": "SELECT unnest(string_split(text, chr(10))) AS line FROM documents",
}
# the same rows by another storage
ORACLE_SQL["tfidf_bucketed"] = ORACLE_SQL["tfidf_long"]
ORACLE_SQL["committed_predictions"] = ORACLE_SQL["nb_predict"]
