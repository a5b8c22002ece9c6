"""siftgraph: DataFrame operators for weakly supervised triple corpora."""

__version__ = "0.1.0"
