"""The stateless parts of the dataflow on Structured Streaming."""
