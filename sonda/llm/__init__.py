"""Training-data operators: one module each; nothing else in the package imports them."""
