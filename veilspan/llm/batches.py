"""Arrow batches cut by the size of their texts; the core has them too."""

from __future__ import annotations

from veilspan.sources.batches import MOST, sliced

__all__ = ["MOST", "sliced"]
