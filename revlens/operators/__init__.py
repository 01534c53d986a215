"""DataFrame operators (take and return DataFrames)."""

from revlens.operators.evaluate import (  # noqa: F401
    confusion_matrix, evaluate, metrics_from_confusion, metrics_report,
)
from revlens.operators.heavy import heavy_vocabulary  # noqa: F401
from revlens.operators.incremental import add_batch, nb_from_statistics  # noqa: F401
from revlens.operators.linear import coefficient_table, linear_margin, vector_to_long  # noqa: F401
from revlens.operators.naive_bayes import fit_nb, score_nb  # noqa: F401
from revlens.operators.observed import write_with_metrics  # noqa: F401
from revlens.operators.prepare import (  # noqa: F401
    add_words, binarize, drop_null_reviews, hash_split, label_balance, prepare, random_split,
    split_valid_scores, with_split,
)
from revlens.operators.skew import hot_cold_join, top_keys  # noqa: F401
from revlens.operators.stem import stem_arrays, stem_tokens  # noqa: F401
from revlens.operators.termstats import (  # noqa: F401
    assemble, corpus_frequency, document_frequency, idf_weights, restrict_to_vocabulary,
    term_frequency, tfidf, token_stream, vocabulary,
)
