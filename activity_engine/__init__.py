"""activity_engine: working-day adjusted follow-up activity analytics on Spark.

Every public operator is a lazy function ``fn(df, ..., params) -> DataFrame``
built from DataFrame API expressions; no action runs inside an operator.
"""

from .params import Params, test_params

__all__ = ["Params", "test_params"]
__version__ = "0.1.0"
