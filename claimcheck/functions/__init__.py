"""Row-local rules, each one a function from Columns to a Column."""
