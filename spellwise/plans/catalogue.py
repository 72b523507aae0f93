"""All queries of the library but those of the optional subpackage."""

from . import causal, charts, histories, metrics  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
