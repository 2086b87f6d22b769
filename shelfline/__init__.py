"""shelfline: retail sales ETL, data quality, demand forecast and reorder
planning expressed as Spark DataFrame jobs.

Every public function takes and returns a DataFrame (sinks and fail-fast
gates are the only places that run an action).
"""

from shelfline.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
