"""Column functions: built-in expressions only, no Python in the data path."""
