"""Spark jobs for tracking research papers and industry news."""
