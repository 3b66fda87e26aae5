"""Streams: the operators this engine re-expresses work on finite tables. Row-level projections (cleaning, normalising,
tokens) are plain column expressions, and so run on `readStream` sources as they are."""
