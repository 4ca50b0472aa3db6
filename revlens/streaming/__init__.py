"""The row-wise operators on unbounded tables."""
