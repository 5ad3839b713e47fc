"""Connected components by alternating large-star and small-star steps over shuffled edges."""

from __future__ import annotations

from newsloom.operators.components import connected_components

__all__ = ["connected_components"]
