"""From files to measured datasets, and the tables that hold them."""
