"""Scalar Column functions; all JVM-side, no Python UDF."""

from stockspark.functions.keys import (composite_key, normalize_piece, split_sku, strip_ws,
                                       collapse_ws, template_key, upper_strip, PIPE, VDOTS)
from stockspark.functions.numeric import (coerce_numeric, parse_number, to_int_safe, whole_number,
                                          stock_status_flag, sign_class,
                                          money)
from stockspark.functions.text import (snake_case, snake_case_col, normalize_header, clean_value,
                                       clean_frame, snake_headers, guess_column, visible_columns)
