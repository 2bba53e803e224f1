"""Table and report sinks."""

from .tables import read_result, write_fact, write_report, write_tables

__all__ = ["read_result", "write_fact", "write_report", "write_tables"]
