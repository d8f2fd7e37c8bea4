"""Column functions: names, rendering of fields, predicates."""
