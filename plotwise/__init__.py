"""plotwise: land-use agreement analytics on PySpark."""
