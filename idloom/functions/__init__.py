"""Column expressions: normalisers, hashes, entity extraction. All are Catalyst expressions, none is a Python UDF."""
