"""siltbed: content-defined chunking, deduplication, versioned snapshots and integrity checks on PySpark."""

__version__ = "0.1.0"
VERSION_PIECES = tuple(map(int, __version__.split(".")))
VERSION_BYTES = b"".join(n.to_bytes(2, "big") for n in VERSION_PIECES)
#: Marks repositories written by this implementation.
IMPLEMENTATION_UUID = "5e8a1c6e-6d1d-4c53-9f0b-51176bed0001"
