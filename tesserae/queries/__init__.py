"""The engine's queries over the generated tables, by family."""
