"""Table-to-table operators: joins, bundles, Merkle trees, proofs, index, checks."""
