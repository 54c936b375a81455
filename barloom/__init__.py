"""Market-bar analytics and corpus preparation as Spark jobs: every function takes and returns DataFrames."""
