"""Declarative specs and the DataFrame plans built from them."""
