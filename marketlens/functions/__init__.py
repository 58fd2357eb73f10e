"""Column expressions: parsing, time spans, exact rounding, delivery rules, measures."""
