"""Sources: sniffed all-string CSV snapshots, typed reads, header offsets, book tables."""

from stockspark.sources.files import (head_until, line_figures, sniff_delimiter, sniff_csv_meta, read_snapshot,
                                      read_typed, read_with_header_row, columns_and_count, preview, with_file_order,
                                      sample_snapshots)
from stockspark.sources.tables import read_table, carriers, settings_defaults, parse_json_list
