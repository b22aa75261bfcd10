"""Operators of a training-data pipeline: packing, filters, near-duplicates, mixing, scans.

Nothing else in the library imports this package. Beside PySpark it needs numpy, pandas, pyarrow, xxhash and tiktoken.
"""
