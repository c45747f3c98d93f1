"""Readers of trades and candles, and the table store."""
