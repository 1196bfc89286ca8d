"""Column expressions and the few numpy kernels behind them."""
