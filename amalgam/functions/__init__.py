"""Column functions: text in Python's sense, value normalisers, and the fixed tables behind them."""
