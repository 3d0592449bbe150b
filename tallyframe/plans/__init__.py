"""Declarative specs and the whole-table analysis built from the operators."""
