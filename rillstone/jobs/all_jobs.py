"""Importing this module registers every job."""

from . import knowledge, logs, stream, streams, workflows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
