"""End-to-end jobs built from the functions and operators."""
