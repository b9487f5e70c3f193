"""Sources: parsers and table adapters that end in DataFrames."""
