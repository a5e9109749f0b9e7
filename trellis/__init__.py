"""Analytics over labelled hierarchies and evaluation data, as DataFrames."""
