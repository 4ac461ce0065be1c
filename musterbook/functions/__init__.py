"""Column expressions: text, clock, calendar and status rules."""
