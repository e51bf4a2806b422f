"""Outreach-campaign analytics as Spark DataFrame, SQL and streaming jobs."""
