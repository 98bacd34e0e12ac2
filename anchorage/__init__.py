"""anchorage: hyperlink extraction and analysis on Spark DataFrames.

Pages (or pre-scanned snapshots) become per-page arrays of link entries,
which are filtered, de-duplicated, ordered, reported and exported with
Spark SQL expressions.  Per-page work stays inside one row (higher-order
functions, no shuffle); corpus-wide work uses partial aggregation.
"""

from anchorage.session import get_spark, shared_dir  # noqa: F401
from anchorage.settings import Settings  # noqa: F401
