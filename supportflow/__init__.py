"""supportflow: support-message analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns); nothing that grows
with the input is collected to the driver.
"""

from supportflow.session import ensure_checkpoint_dir, get_spark

__all__ = ["get_spark", "ensure_checkpoint_dir"]
