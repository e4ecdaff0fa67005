"""Column-level functions: pure Catalyst expressions, no Python UDFs."""

from flowlens.functions.scalar import (
    PORT_CATEGORY_LABELS, SERVICES, is_deny, is_tcp, out_of_plan, pct, port_bucket, port_category,
    safe_ratio, services_df, with_calendar, with_flags, with_service, word_bucket, words,
)
from flowlens.functions.sql import register_functions

__all__ = [
    "PORT_CATEGORY_LABELS", "SERVICES", "is_deny", "is_tcp", "out_of_plan", "pct", "port_bucket",
    "port_category", "register_functions", "safe_ratio", "services_df", "with_calendar", "with_flags",
    "with_service", "word_bucket", "words",
]
