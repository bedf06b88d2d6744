"""wavemill: adaptive time-series decomposition and analysis as Spark jobs."""

__version__ = "0.1.0"
