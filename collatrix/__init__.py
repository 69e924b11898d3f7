"""collatrix: comparison of document versions, review tracking and training-data operators on Spark."""
