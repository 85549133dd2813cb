"""shopstat: sales analytics on PySpark.

Every operator is a function from DataFrame(s) to DataFrame, planned by
Catalyst.  Sub-packages:

- ``sources``    role views over the input tables, file scans, sinks
- ``functions``  column-expression helpers (bands, time parts, text, p-values)
- ``operators``  cleaning, nested data, sessions, marts, statistics, quality, profiling
- ``plans``      metric registry, query catalogue, batch table build
- ``streaming``  incremental session rollup
"""

from shopstat.session import get_session

__all__ = ["get_session"]
