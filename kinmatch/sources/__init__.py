"""Readers and writers of the tab-separated inputs and outputs."""
