"""Privacy analytics and corpus preparation over DataFrames."""
