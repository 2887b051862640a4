"""Operators over frames of documents, facts, organizations, jobs and imports."""
