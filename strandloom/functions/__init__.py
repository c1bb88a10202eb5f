"""Column functions: counter-based random numbers, sequences, alignments."""
