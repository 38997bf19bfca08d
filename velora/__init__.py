"""velora: hourly site-count analytics on Spark DataFrames.

Subpackages
-----------
sources    scans of landed files and of the driver's tables, plus derived frames
sinks      append, upsert, overwrite and maintenance of stored tables
functions  column expressions (calendar, weather flags, coordinates, labels)
operators  DataFrame -> DataFrame building blocks (lags, dedupe, stats, tests)
plans      whole jobs composed from operators (features, forecast, serving, training)
streaming  high-water-mark increments and the file-source stream
"""

__all__ = ["session"]
