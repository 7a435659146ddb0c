"""Models that assert values, as callables that the caller brings."""
