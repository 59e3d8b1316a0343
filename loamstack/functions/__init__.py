"""Column expressions: fixed values, text normalisation, recognition and rendering."""
