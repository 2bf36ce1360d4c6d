"""chronoweave: entity-timeline analytics as PySpark DataFrame operators."""
