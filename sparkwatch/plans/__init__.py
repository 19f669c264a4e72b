"""From rules to expressions: conditions, predicates, and what can be told of a rule before it runs."""
