"""sparkpairs: Spark-native building, corruption, sampling, rendering, profiling
and scoring of text-correction training pairs.

Every operator takes and returns DataFrames (or Columns); randomness is keyed
on row content so results do not depend on partitioning, retries or order.
"""

from sparkpairs.session import get_session, checkpoint_dir, materialize

__all__ = ["get_session", "checkpoint_dir", "materialize"]
