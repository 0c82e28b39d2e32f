"""mnemolake: analytics over the memory of AI agents, on Spark DataFrames."""

__version__ = "0.1.0"
