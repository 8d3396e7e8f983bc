"""The given tables in the library's model, and one query for each operator over them."""
