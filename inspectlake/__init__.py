"""Inspection and measurement document feeds on Spark.

The subpackages follow the life of a document: ``sources`` read files,
``plans`` say how a record becomes tables, ``operators`` query the tables,
``streaming`` keeps them up to date, ``functions`` hold the shared column
expressions and ``workload`` maps all of it onto the supplied test tables.
"""

from inspectlake.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
