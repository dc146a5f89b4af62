"""Column functions: text, rules, extraction, vectors."""
