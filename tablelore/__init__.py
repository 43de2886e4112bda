"""A data dictionary for tables of any size, written as plain PySpark DataFrame work."""
