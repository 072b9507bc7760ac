"""colloquy: timed, speaker-attributed conversation data on Spark DataFrames."""
