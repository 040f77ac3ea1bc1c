"""Whole runs: from input files to output files."""
