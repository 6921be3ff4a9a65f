"""End-to-end compositions (E1–E6), test-table bindings and the query registry."""
