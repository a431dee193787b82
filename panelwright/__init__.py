"""Point-in-time analytics over dated entity panels, written as Spark DataFrame operators."""
