"""Readers and writers: blobs, rubrics, rating forms, override logs, provider records, reports."""
