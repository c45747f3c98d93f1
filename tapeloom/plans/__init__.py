"""Registered queries with their SQL counterparts, and the daily job."""
