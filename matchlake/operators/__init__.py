"""Generic DataFrame operators; columns are arguments."""
