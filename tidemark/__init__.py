"""tidemark: supply-chain analytics as Spark DataFrame operators.

Every operator is a pure function DataFrame -> DataFrame built from the
public PySpark API, so Catalyst plans it and the work runs distributed.
"""

__version__ = "0.1.0"
