"""Operators: barcode matching, mate handling, trimming, metrics and quality control."""
