"""End-to-end jobs: relational naive Bayes, MLlib pipelines, persistence."""

from revlens.plans.persist import load_fitted, save_fitted  # noqa: F401
from revlens.plans.pipelines import (  # noqa: F401
    fit_extractor, fit_text_pipeline, fit_word2vec_pipeline, score,
)
from revlens.plans.relational import (  # noqa: F401
    build_corpus, classify_and_evaluate, count_vector_nb, ngram_tfidf_features, ngram_tfidf_nb,
)
