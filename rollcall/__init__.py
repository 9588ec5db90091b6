"""rollcall: rollout preparation, scoring and analysis on Spark.

Every public operator is a DataFrame-in / DataFrame-out function built from
``pyspark.sql.functions``, higher-order array functions, windows and joins,
so Catalyst plans it and Tungsten runs it. A few Arrow-batched pandas UDFs
cover what the built-ins cannot express (balanced CTE scan, Python AST audit,
user tokenizers).
"""

__version__ = "0.1.0"
