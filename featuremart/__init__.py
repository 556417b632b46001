"""Spark-native daily product-feature mart.

Layout:
  sources/    scans of the daily partitioned source tables and the test-data binding
  operators/  reusable DataFrame operators (semi-join restriction, stack-and-sum, top-n, DAU, ...)
  functions/  column expressions and aggregate helpers, SQL registration
  plans/      the feature jobs (sales, visits, favourite/cart, search, members, gather, sales volume)
  sink.py     partitioned, idempotent day-partition writes
"""

__all__ = ["session", "schemas", "sink"]
