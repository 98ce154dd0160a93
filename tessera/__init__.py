"""Tessera: a Spark-first engine for evidence retrieval and corpus curation.

Operators are functions from DataFrames to DataFrames.  Nothing here starts a
session; see :mod:`tessera.session` for the settings the engine expects.
"""

__version__ = "0.1.0"
