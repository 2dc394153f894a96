"""Graph mini-batching and full-graph scoring as Spark jobs."""
