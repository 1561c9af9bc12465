"""Comments on marked-up drawings to billable quantities.

Comments are shuffled once, by all their columns, and stay where they are from then on: each
shape of a token is read once and joined back, and what a token's neighbours decide comes from
windows over its comment. Quantities are then added up per document and item.
"""

from tallyline.operators.annotations.classify import comments, excluded_comments, items, notes, of_each, token_events, unresolved
from tallyline.operators.annotations.rollup import (
    asbuilt_lines, describe_items, ingest_warnings, item_quantities, record_counts, record_counts_of_each,
)

__all__ = [
    "asbuilt_lines", "comments", "describe_items", "excluded_comments", "ingest_warnings", "item_quantities", "items",
    "notes", "of_each", "record_counts", "record_counts_of_each", "token_events", "unresolved",
]
