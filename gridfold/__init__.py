"""Evidence maps from range sensors, and training-data operators, on PySpark DataFrames."""
