"""tessera: tabular data-quality and stacked-scoring operators on Spark DataFrames.

Every operator is a function ``f(df, *, columns, key, ...) -> DataFrame`` that
builds a lazy Spark plan.  Fitted statistics are small DataFrames (or small
dicts collected from one-row aggregates); nothing proportional to the data is
ever collected to the driver.
"""

from tessera.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
