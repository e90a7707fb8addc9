"""Named queries over the test tables, with the SQL that checks them."""

from __future__ import annotations

from . import box_queries, interval_queries, legacy_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = QUERIES["select_top1"]
