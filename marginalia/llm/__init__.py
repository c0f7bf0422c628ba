"""Training-data operators: ten corpus operators and their queries. Nothing outside this folder imports it."""
