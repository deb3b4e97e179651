"""Training-data operators: one module per operator; nothing outside this folder imports them."""
