"""Column expressions: text, dates and the predicates that classify notices."""
