"""Search over built collections: the query interface, HTML reports and the command line."""
