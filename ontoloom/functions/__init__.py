"""Column functions and value spaces."""
