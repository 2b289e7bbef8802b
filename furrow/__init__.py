"""furrow: trend analytics over long-format statistics tables on Spark.

Every operator is a ``DataFrame -> DataFrame`` function that declares its
plan with the DataFrame/SQL API; Catalyst and AQE pick the physical plan.
Series are keyed explicitly (``keys``) so the single national series of a
classic yield study is just the one-group case of a grouped job.
"""

from furrow.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
