"""Jobs that run the library's operators over stored tables from a command line."""
