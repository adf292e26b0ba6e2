"""End-to-end batch jobs built from the operators."""
