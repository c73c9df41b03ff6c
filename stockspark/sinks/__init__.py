"""Sinks: CSV/Parquet writers, chunked import files, named subset exports."""

from stockspark.sinks.writers import (write_csv, rounded_view, clean_export, write_chunks, write_bounded_files,
                                      write_parquet, write_subsets)
