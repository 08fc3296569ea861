"""noteloom: note analytics, agent memory and versioned stores on Spark DataFrames."""
