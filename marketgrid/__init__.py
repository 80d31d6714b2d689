"""marketgrid: marketplace analytics as Spark jobs over whole tables."""
