"""Readers: parquet tables, source trees and change-set text."""
