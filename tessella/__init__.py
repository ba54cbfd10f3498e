"""Tessella: a Spark-native engine for embedding, retrieval and corpus preparation.

Every public operator takes DataFrames and returns a DataFrame; nothing here holds rows on the driver.
"""

__version__ = "0.1.0"
