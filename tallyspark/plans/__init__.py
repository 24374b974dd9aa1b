"""Plan shapes shared by the operators: ordered totals, exact quantiles, written tables."""
