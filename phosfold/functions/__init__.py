"""Column functions: peptides, accessions, statistics."""
