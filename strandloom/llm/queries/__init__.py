"""The training-data queries, one module for each operator."""
