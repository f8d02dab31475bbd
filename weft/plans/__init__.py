"""Planning: paths over relations, and the order of rules and sources."""
