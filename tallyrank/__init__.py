"""tallyrank: word counts and link ranks over changing data, batch and
streaming, as Spark DataFrame operators whose incremental results equal a
full recompute."""

__version__ = "0.1.0"
