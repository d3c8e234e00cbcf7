"""sessionloom: transcript analytics and corpus preparation on PySpark.

Everything is a function from DataFrame to DataFrame. Operators never look at
the wall clock (``as_of`` is a parameter) and never gather data on the driver
beyond what is bounded by a schema or a documented parameter.
"""

__version__ = "0.1.0"
