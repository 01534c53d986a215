"""Structured Streaming entry points (scoring and training over arriving files)."""

from revlens.streaming.scorer import score_files, stream_predictions  # noqa: F401
from revlens.streaming.trainer import train_files  # noqa: F401
