"""Sources and sinks: driver tables, the flow view, raw lines, file layouts, writers."""

from flowlens.sources.tables import TABLES, load, raw_lines, flows

__all__ = ["TABLES", "load", "raw_lines", "flows"]
