"""zonewise: areal exposure estimation on Spark DataFrames."""

from zonewise.session import tune

__all__ = ["tune"]
