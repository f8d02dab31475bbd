"""Reading projects and tables, writing results."""
