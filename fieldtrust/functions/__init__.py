"""Column -> Column building blocks; built-in expressions only."""
