"""Network-flow analytics as Spark DataFrame operators.

Every operator takes a flows DataFrame (see :mod:`flowlens.schema`) and returns
a DataFrame; nothing here runs outside Spark except fixed-size model algebra.
"""

__version__ = "0.1.0"
