"""The registered queries, each beside the SQL that must give the same table."""
