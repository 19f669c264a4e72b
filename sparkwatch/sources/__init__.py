"""Readers and writers of log files, rules and catalogues."""
