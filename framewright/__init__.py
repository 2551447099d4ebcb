"""DataFrame-in, DataFrame-out operators for datasets of episodes, on Spark."""
