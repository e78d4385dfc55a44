"""Readers and writers: tables, JSON lines, commit logs, retention."""
