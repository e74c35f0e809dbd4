"""Reading raw lines, and the tables events and alerts are kept in."""
