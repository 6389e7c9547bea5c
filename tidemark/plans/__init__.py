"""Whole plans: dashboard, backtest, refresh, registered queries and their SQL twins."""
