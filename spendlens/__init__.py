"""Transaction analytics as small DataFrame -> DataFrame functions for PySpark."""
