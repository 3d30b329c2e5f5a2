"""Inputs: files, directories, globs, lake tables and remote paths as DataFrames with a described schema."""
