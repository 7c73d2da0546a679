"""runlens: analyse fleets of build/agent runs with Spark DataFrames.

Every public operator takes and returns DataFrames (or Columns) and is built
from Spark SQL built-in functions, so Catalyst can prune, push down and
pipeline it. See README.md for the module map.
"""

from runlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
