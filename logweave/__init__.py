"""Analytics over replicated command logs and key-value state, written for Spark."""
