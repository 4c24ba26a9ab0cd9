"""Column functions: hashing, codecs, object paths, digests."""
