"""marketgrid.streaming."""
