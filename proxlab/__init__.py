"""proxlab: distributed optimization and learning operators on PySpark DataFrames.

Layout
------
sources/    readers and writers (dense text, column text, LibSVM, delimited, models)
functions/  Column-expression building blocks (proximal maps, array algebra)
operators/  data preparation, linear-algebra passes, solvers, learners, metrics
plans/      derived design matrices over the driver tables and the query registry
streaming/  notes on using the Column-expression scorers on streaming DataFrames
"""

__version__ = "0.1.0"
