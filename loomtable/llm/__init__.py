"""Training-data operators: each in a module of its own, their queries in ``queries``."""
