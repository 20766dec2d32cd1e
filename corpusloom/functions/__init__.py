"""Scalar functions: native columns, and Arrow UDFs where no built-in can express them."""
