"""flowlens: firewall-flow analytics expressed as Spark DataFrame / SQL / Structured Streaming jobs.

Every public function is lazy: it takes DataFrames (or a session and a path) and returns an
unevaluated DataFrame, so Catalyst can prune, push down and plan the whole job at once.
"""

from flowlens.session import get_spark, work_dir

__all__ = ["get_spark", "work_dir"]
__version__ = "0.1.0"
