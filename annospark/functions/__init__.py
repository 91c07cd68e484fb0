"""Column functions: unsigned 64-bit keys, shard hash, Morton codes, segment colours."""
