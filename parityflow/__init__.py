"""parityflow: compare, reconcile and migrate tables with Spark DataFrames.

Every operator takes DataFrames and returns a lazy DataFrame.
"""

from parityflow.config import CompareConfig, MigrationConfig

__all__ = ["CompareConfig", "MigrationConfig"]
