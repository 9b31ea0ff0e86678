"""Column expressions and statistics that the operators share."""
