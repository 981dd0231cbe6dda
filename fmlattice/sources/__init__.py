"""Sources and sinks: parquet tables, delimited text, libFM sparse text."""

from .text import (filter_comment_blank, libfm_dimension, libfm_lines, parse_libfm,
                   read_delimited, read_libfm, write_delimited, write_libfm)

__all__ = ["filter_comment_blank", "libfm_dimension", "libfm_lines", "parse_libfm",
           "read_delimited", "read_libfm", "write_delimited", "write_libfm"]
