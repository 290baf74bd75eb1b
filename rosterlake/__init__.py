"""rosterlake: facility-level service supply and training-data operators on PySpark."""
