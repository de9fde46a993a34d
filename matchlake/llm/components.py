"""Connected components, as the corpus operators use them."""

from matchlake.operators.components import components

__all__ = ["components"]
