"""Readers and writers. Everything goes through Spark's file systems; binary formats are parsed in Arrow functions."""
