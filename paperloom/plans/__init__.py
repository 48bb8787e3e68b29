"""Plan shapes shared by the operators: skew-safe group picks, running totals, look-ahead."""
