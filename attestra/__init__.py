"""Evidence analytics as Spark plans."""
