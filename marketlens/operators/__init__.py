"""DataFrame-to-DataFrame operators: cleaning, grains, lookups, medians, quality checks."""
