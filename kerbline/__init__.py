"""Step-free pedestrian routing data jobs on Spark."""
