"""Column expressions: no function in this package touches a DataFrame's rows."""
