"""The same cleaning on streams: Structured Streaming forms of the batch operators."""
