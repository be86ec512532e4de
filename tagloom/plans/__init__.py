"""Run configuration and the demultiplexing plan."""
