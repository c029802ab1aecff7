"""wayline: trajectories, road networks and map matching on Spark DataFrames."""
