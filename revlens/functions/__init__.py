"""Column-level functions (native Spark expressions)."""

from revlens.functions.labels import (  # noqa: F401
    IMDB_CLASS_MAP, TWITTER_CLASS_MAP, binarize_score, map_class_labels,
)
from revlens.functions.stopwords import ENGLISH_STOP_WORDS  # noqa: F401
from revlens.functions.text import (  # noqa: F401
    clean_text, filter_short_tokens, hash_bucket, ngrams, remove_stopwords,
    split_label, tokenize,
)
