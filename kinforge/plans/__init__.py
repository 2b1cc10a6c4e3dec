"""Named queries over the test tables, with their oracles."""

from kinforge.plans import registry
from kinforge.plans import core, evaluation, noise, retrieval, scaling  # noqa: F401  (they fill the registry)

__all__ = ["registry"]
