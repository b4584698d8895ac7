"""Query plans built from operators, with their SQL twins."""
