"""kumihimo: cultural-graph analytics as Spark DataFrames.

Entities, five-axis tags and scored edges are plain tables; every operator
takes DataFrames and returns a DataFrame, so Catalyst plans the whole query.
"""

__version__ = "0.1.0"
