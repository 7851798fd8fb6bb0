"""tideline: incremental graph-pattern and relational queries on PySpark."""

__version__ = "0.1.0"
