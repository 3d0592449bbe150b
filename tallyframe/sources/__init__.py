"""Reading and writing tables, analysis results and models."""
