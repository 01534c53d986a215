"""Sources and sinks."""

from revlens.sources.committed import commits, read_committed, write_committed  # noqa: F401
from revlens.sources.files import (  # noqa: F401
    CSV_OPTIONS, OWN_COLUMNS, REVIEW_COLUMNS, labelled_reviews, read_lines, read_reviews_csv, with_line_ids, write_predictions,
    write_reviews_csv,
)
from revlens.sources.splits import read_numbered_lines, read_records  # noqa: F401
from revlens.sources.tables import (  # noqa: F401
    annotations, labelled_documents, read_table, reviews, reviews_with_nulls,
)
