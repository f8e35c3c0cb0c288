"""Ranked search over file and document names, written as Spark DataFrame jobs."""
