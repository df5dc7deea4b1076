"""Readers and writers of samples, predictions, question corpora, task configurations and reports."""
