"""isobar: gridded-field, geometry and record-catalog analytics as Spark plans."""
