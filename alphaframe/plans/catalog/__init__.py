"""All registered queries, by theme; importing this module fills the registry."""

# Order matters: later themes reuse the sub-queries of earlier ones.
from . import windows  # noqa: F401, I001
from . import sources, research, portfolio, risk, overlay, meta, registry, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
