"""Readers and writers of terminologies, query tables, pools and results."""
