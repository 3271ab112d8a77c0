"""Readers and writers of tables and documents."""
