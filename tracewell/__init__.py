"""tracewell: analytics of agent trajectories, and corpus operators, on Spark."""
