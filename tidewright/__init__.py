"""tidewright: an analytics engine on PySpark DataFrames."""
