"""All registered queries and their SQL, by name."""

from . import catalogue, changes, curation, graph, scalars, search, streams, usage  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
