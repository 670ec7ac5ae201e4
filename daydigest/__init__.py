"""Ranked, sourced daily digests of short texts, as PySpark DataFrame jobs."""
