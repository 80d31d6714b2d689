"""marketgrid.operators."""
