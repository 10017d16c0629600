"""Operators over block tables. All take and return DataFrames; none collects data to the driver."""
