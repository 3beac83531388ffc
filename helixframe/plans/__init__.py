"""Jobs over whole tables, and the registered queries."""
