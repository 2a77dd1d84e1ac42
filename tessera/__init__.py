"""tessera: access governance and verified data movement on Spark.

Every operator takes and returns Spark DataFrames; decisions, audits, changes
and copies are declared with the DataFrame/SQL API so Catalyst and AQE pick the
physical plan.
"""

import sys

from pyspark import cloudpickle

from tessera.session import checkpoint_dir, get_session

# functions that run inside tasks travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "checkpoint_dir"]
