"""brindle: customer, commerce and corpus analytics on Spark DataFrames."""
