"""DataFrame operators: record resolution and the graph routine under it."""
