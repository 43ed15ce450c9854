"""Plans: projection and validation compiled from a configuration, and the run from files to results."""
