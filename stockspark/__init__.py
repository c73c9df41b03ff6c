"""stockspark: stock reconciliation and order-book analytics on Spark.

Every operator takes DataFrames (plus a small config object) and returns a
lazy DataFrame; nothing is collected to the driver except bounded metadata
(header samples, quantile boundaries, partition counts).
"""

from stockspark.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
