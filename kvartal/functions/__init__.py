"""Column expressions: text, numbers, dates, money, distance."""
