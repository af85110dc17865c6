"""Column functions: scalar derivations that stay inside code generation."""
