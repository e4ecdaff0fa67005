"""The dashboard's panels under one filter state (D11): every panel reads the same filtered
frame, so Catalyst pushes one predicate into every scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.scalar import port_category, with_service
from flowlens.operators import kpi, topk
from flowlens.operators.filters import FilterSpec, apply_filter, selectivity
from flowlens.operators.profiles import ip_behaviour


def dashboard_panels(df: DataFrame, spec: FilterSpec) -> dict[str, DataFrame]:
    """Lazy DataFrames for each panel of the descriptive dashboard under ``spec``."""
    f = apply_filter(df, spec).withColumn("port_category", port_category())
    return {
        "kpis": kpi.kpis(df),                                   # the overview ignores the filter
        "selectivity": selectivity(df, spec),
        "protocol_action": kpi.crosstab(f, "protocol"),
        "daily_port_category": kpi.daily_port_category(f),
        "range_presets": kpi.range_presets(f),
        "block_rate": kpi.block_rate(f, "protocol"),
        "top_ports_by_protocol": topk.top_k_per(f, "protocol", "dest_port", 5),
        "port_category_share": kpi.share(f.select("port_category"), "port_category"),
        "port_category_action": kpi.crosstab(f, "port_category"),
        "top_source_ips": topk.top_k(f, "ip_source", 5),
        "ip_behaviour": ip_behaviour(f),
        "privileged_ports": with_service(topk.top_k(f, "dest_port", 10, where=F.col("dest_port") < 1024),
                                         default="Autre"),
    }
