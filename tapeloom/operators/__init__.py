"""Replay, bars, features, rules, evidence and research over DataFrames."""
