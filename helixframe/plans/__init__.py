"""Query catalogue: one entry for each operator, over projections of the driver's tables."""
