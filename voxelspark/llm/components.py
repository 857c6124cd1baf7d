"""Connected components of links by the library's distributed union-find.

Links with a null end and loops are ignored; an empty table of links gives no rows.
"""

from __future__ import annotations

from ..operators.graphs import components

__all__ = ["components"]
