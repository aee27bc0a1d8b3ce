"""Strandline: a Spark-native analytics engine for code and document context.

The subpackages are layered: ``functions`` (column expressions), ``sources`` (tables and incremental input),
``operators`` (DataFrame to DataFrame), ``streaming`` (stateful twins), ``plans`` (registered queries).
``llm`` holds the operators for training text and is optional: nothing outside it imports it.
"""

__version__ = "0.1.0"
