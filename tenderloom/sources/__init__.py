"""Tables, adapters and sinks."""
