"""Column expressions: everything here is Column -> Column and runs inside one stage."""
