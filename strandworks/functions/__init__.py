"""Fixed tables, expressions and numeric kernels."""
