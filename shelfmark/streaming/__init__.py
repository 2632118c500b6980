"""No streaming operators: every table of this library is a batch table."""
