"""Billing reconciliation over Spark DataFrames.

``functions``  column builders (text, numbers, messages, similarity)
``sources``    raw grids, archives, comments and the table store
``operators``  one module per step of the reconciliation
``plans``      steps put together: a whole cycle, the registered queries
``streaming``  the incremental form of invoice intake and cycle saving
"""

__version__ = "0.1.0"
