"""Column expressions: everything here is native Spark SQL unless a name says otherwise."""
