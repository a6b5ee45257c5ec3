"""flowlane: PySpark-native analytics for road-flow observations.

Every public operator takes and returns Spark DataFrames; nothing is
collected to the driver except bounded, fitted scalars (bucket counts,
one-row parameter tables).
"""

__version__ = "0.1.0"
