"""Writers: fact tables, stored aggregates, views and report text."""
