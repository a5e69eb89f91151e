"""Maritime radar / ship-tracking analytics as Spark DataFrame operators."""
