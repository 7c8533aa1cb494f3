"""Readers and writers: registries, text files, evaluation cases, tables and artifacts."""
