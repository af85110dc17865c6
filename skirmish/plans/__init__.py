"""Jobs and the query library, composed of operators."""
