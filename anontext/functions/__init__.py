"""Column expressions: answer extraction, name cleaning and similarity, identification flags."""
