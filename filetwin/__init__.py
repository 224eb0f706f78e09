"""File-catalog and duplicate analytics as Spark jobs over DataFrames."""
