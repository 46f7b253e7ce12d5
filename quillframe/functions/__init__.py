"""Values, functions and aggregates of the dialect."""
