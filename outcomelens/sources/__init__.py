from .report import in_order, report_payload
from .scratch import Scratch
from .stacked import read_stacked, split_stacked
from .tables import export_csv, load_counts, load_tables, read_lookup, read_text_table, small_table

__all__ = [
    "Scratch",
    "export_csv",
    "in_order",
    "load_counts",
    "load_tables",
    "read_lookup",
    "read_stacked",
    "read_text_table",
    "report_payload",
    "small_table",
    "split_stacked",
]
