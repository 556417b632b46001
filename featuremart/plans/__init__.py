"""Feature jobs. Each takes a ``SourceTables`` and a ``yyyyMMdd`` day and returns a DataFrame; only
the sink (``featuremart.sink``) materialises anything."""
