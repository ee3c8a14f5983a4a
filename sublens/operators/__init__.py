"""DataFrame operators: one function per inventory item."""
