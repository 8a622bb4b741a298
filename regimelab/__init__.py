"""Volatility regimes on Spark: range estimators, point-in-time features, forecasts, alarms and backtests as DataFrame plans."""
