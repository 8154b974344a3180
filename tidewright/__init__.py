"""tidewright: interaction-stream analytics and corpus compilation on Spark.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame
operators), ``sources`` (readers and writers), ``plans`` (registered queries),
``streaming`` (stateful session processing).
"""
