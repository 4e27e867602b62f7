"""Flow analysis on Spark DataFrames: ordered records in, blocks, graphs and facts about them out."""
