"""creditlake — customer credit analytics as Spark DataFrame plans.

Sub-packages: ``sources`` (role views, readers, sinks), ``functions`` (column
helpers, distributed running totals, bounded exact quantiles, p-values),
``operators`` (aggregates, cleaning, features, marts, statistics, metrics,
economics, MLlib models) and ``plans`` (customer-360 pipeline, registered queries
and their SQL oracles).
"""

__version__ = "0.1.0"
