"""Column functions: plain expressions, no user-defined code, so all of them stay inside generated code."""
