"""Column expressions and the beta-quantile function."""
