"""SPARQL 1.0 graph-pattern queries as Spark DataFrame plans."""
