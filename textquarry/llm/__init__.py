"""Training-data operators: one module each, and the catalogue of their queries."""
