"""Pipeline lineage, log and run analytics as Spark DataFrame operators."""
