"""loglens: HTTP access-log anomaly detection expressed as Spark jobs.

Cleaning, feature derivation, an isolation forest grown in parallel Spark
tasks, F1 threshold selection, scoring and a detection-history table.
"""

from loglens.schema import FEATURE_COLUMNS, LABEL_COLUMNS, LOG_COLUMNS

__all__ = ["FEATURE_COLUMNS", "LABEL_COLUMNS", "LOG_COLUMNS"]
