"""Readers and writers: tables, landed JSON, read plans, insert-if-absent, CSV, model bundles."""
