"""Attendance reconciliation as Spark DataFrame jobs."""
