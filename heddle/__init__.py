"""heddle: a PySpark-native engine for code and document graphs.

Nodes and edges are DataFrames; every operator is a function from DataFrames to
DataFrames, so Catalyst plans the whole query.  The optional subpackage
``heddle.llm`` holds the operators for training data; nothing here imports it.
"""

__version__ = "0.1.0"
