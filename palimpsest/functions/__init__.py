"""Column expressions: canonical forms and similarities."""
