"""Column builders: everything here is an expression, nothing runs a job."""
