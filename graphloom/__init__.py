"""graphloom: source-graph analytics, webhook ledgers and corpus operators on PySpark."""

__version__ = "0.1.0"
