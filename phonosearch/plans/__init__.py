"""Queries and the plans behind them."""
