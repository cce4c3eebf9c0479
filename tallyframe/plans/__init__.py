"""The three analyses, each a set of operators on one table, with a command line."""
