"""Table-in / table-out analysis operators."""
