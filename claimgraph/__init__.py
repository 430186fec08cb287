"""claimgraph: a Spark-native engine for sourced, time-scoped, weighted claims."""

__version__ = "0.1.0"
