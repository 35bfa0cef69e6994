"""Functions over bars that a request names with parameters."""
