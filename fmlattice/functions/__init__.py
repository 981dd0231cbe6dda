"""Scalar functions (Column -> Column), all built-in Spark expressions."""

from .columns import (epoch_seconds, epoch_to_days, format_compact, hash_gauss,
                      hash_uniform, list_weights, quote_regex, split_keep_java,
                      split_list, to_number, trunc_div)

__all__ = ["epoch_seconds", "epoch_to_days", "format_compact", "hash_gauss",
           "hash_uniform", "list_weights", "quote_regex", "split_keep_java",
           "split_list", "to_number", "trunc_div"]
