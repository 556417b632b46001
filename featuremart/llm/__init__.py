"""Training-data operators on whole corpora.

Nothing else of the library imports this package. Every operator module holds the general operator
(any table, any column names) and the thin query ``opN_<name>(spark, sf_dir)`` that applies it with
its production parameters to a whole table.
"""
