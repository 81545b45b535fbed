"""Column expressions: clock arithmetic, id cleaning, sequences, dense blocks, losses."""
