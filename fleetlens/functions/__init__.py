"""Column expressions the reports share. All are built from native functions."""
