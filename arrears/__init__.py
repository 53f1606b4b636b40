"""Monthly loan-panel analytics expressed as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or small fitted
values); the heavy work stays inside Catalyst plans so that it scales
with the cluster rather than with the driver.
"""

__all__ = ["session"]
