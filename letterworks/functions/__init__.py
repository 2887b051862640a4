"""Column expressions: text, dates, money, identifiers, hashes."""
