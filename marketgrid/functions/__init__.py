"""marketgrid.functions."""
