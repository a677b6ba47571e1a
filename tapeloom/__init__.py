"""Market-panel, event-stream and signal-evaluation operators on Spark DataFrames."""
