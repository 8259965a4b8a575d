"""Writers. Each has a table form (a DataFrame) and a function that writes it."""
