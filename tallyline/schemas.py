"""Column layouts of the domain tables.

``line_no`` orders the lines of one feed. It may be any orderable type (a BIGINT for
files, a struct of natural keys for tables that carry no counter).
"""

from __future__ import annotations

CYCLE_KEYS = ("project_id", "contractor_id", "cycle_no")
UNIT_KEYS = CYCLE_KEYS + ("unit_key",)

FLAG = "struct<rule:string,severity:string,message:string>"

CONTRACT_ITEM = (
    "project_id string, code string, description string, uom string, unit_price double, "
    "est_qty double, is_change_order boolean, effective_date string, line_no bigint"
)
ASBUILT_LINE = (
    "project_id string, contractor_id string, cycle_no int, line_no bigint, raw_desc string, "
    "qty double, uom string, segment string, code string, source_file string, "
    "source_ref string, confidence string"
)
INVOICE_LINE = (
    "project_id string, contractor_id string, cycle_no int, line_no bigint, invoice_id string, "
    "raw_desc string, qty double, unit_price double, amount double, period string, "
    "is_cumulative boolean, code string, source_file string, line_ref string"
)
ALIAS = (
    "normalized_desc string, code string, confidence double, confirmed_by string, "
    "confirmed_at timestamp"
)
BILLING_CYCLE = (
    "project_id string, contractor_id string, cycle_no int, period_label string, "
    "billing_mode string, retainage_pct double, prior_billed_to_date double, status string, "
    "created_at timestamp"
)
RECON_RESULT = (
    "project_id string, contractor_id string, cycle_no int, code string, description string, "
    "uom string, built_qty double, billed_qty double, contract_price double, "
    "billed_price double, est_qty double, billed_amount double, expected_amount double, "
    f"variance double, severity string, flags array<{FLAG}>, resolution string, "
    "resolution_note string, resolved_by string, resolved_at string"
)
RESOLUTION_EVENT = (
    "project_id string, contractor_id string, cycle_no int, row_key string, seq bigint, "
    "status string, note string, by string, at string"
)
TEMPLATE_PROFILE = (
    "contractor string, header_row int, table_index int, columns map<string,int>, "
    "updated_at timestamp, deleted boolean"
)
AUDIT_LOG = (
    "ts timestamp, seq bigint, actor string, action string, entity string, entity_id string, "
    "detail map<string,string>"
)
ANNOTATION = (
    "doc_id string, page int, ann_no int, subtype string, text string, author string, "
    "x double, y double"
)
GRID = "file string, page int, table_no int, row_no int, cells array<string>"
