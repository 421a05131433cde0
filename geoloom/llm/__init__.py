"""Training-data operators: ten corpus-scale building blocks over text and vector tables.

Nothing else in ``geoloom`` imports this subpackage.  Every operator takes and returns DataFrames, keeps
data distributed, and writes what it must reuse to the shared folder named by ``spark.checkpoint.dir``.
"""
