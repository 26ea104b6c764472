"""Song and artist catalogue analytics on PySpark.

Operators are plain functions from DataFrame to DataFrame, meant to be chained
with ``df.transform``.  Sub-packages: ``sources`` (reading and writing),
``functions`` (column expressions), ``operators`` (one operator each) and
``plans`` (the catalogue questions put together from them).
"""
