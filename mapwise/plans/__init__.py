"""Plan helpers: session settings, shared storage, salted joins, two-level numbering."""
