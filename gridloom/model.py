"""Options and the schemas of the canonical tables."""

from __future__ import annotations

from dataclasses import dataclass

TEXT_ITEMS = "doc_id int, page int, seq int, item_type string, text string, x double, y double, width double, height double, is_bold boolean"
#: Enumerated values of the interchange.
SOURCES = ("vector-grid-cells", "region-tables", "clustered")
WARNINGS = ("needs-ocr", "tier-incomplete", "tier-fallback", "unassigned-text", "region-count-unstable", "table-merge-ambiguous")


@dataclass(frozen=True)
class Options:
    """What a conversion may be told; the defaults are those of the reference behaviour."""

    page_numbers: tuple[int, ...] = ()
    extraction: str = "clustered"  # clustered | positions | auto | markdown-legacy
    worksheet_policy: str = "auto"  # auto | per-region | stacked
    merge_continuations: bool = True
    keep_repeated_headers: bool = False
    include_page_column: bool = False
    include_entry_column: bool = False
    sheet_name: str = "Extracted tables"
