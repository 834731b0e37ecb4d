"""How operators are bound to tables, iterated and registered."""
