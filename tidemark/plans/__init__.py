"""All queries on the driver's tables, with the SQL that gives the same rows."""
