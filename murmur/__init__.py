"""murmur — Spark-native analytics for large collections of short public texts.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, joins, aggregates and windows, so Catalyst can prune, push down
and plan the work; nothing is collected to the driver on the hot path.
"""

from murmur.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
