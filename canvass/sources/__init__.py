"""Readers and writers of campaign files, landed JSON and lookups."""
