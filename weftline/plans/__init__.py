"""The queries of the library by name, with SQL for their results."""
