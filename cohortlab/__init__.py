"""cohortlab: clinical-prediction analytics as Spark DataFrame jobs.

Every public operator takes DataFrames (plus plain parameters) and returns a
lazy DataFrame keyed by explicit ids; nothing relies on row order.
"""

from cohortlab.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
