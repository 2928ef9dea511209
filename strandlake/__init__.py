"""strandlake: Spark-native sequence analytics, measurement ETL and candidate screening."""

__version__ = "0.1.0"
