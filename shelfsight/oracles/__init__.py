"""SQL counterparts of the registered queries, for an independent engine to run on the
sample tables. Written for checking, not speed, and without the Spark plans' shortcuts."""

from shelfsight.oracles.statements import ORACLES

__all__ = ["ORACLES"]
