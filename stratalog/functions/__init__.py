"""Column functions: signatures, bands, similarities, hex and colours, Hilbert keys."""
