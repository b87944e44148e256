"""From text to DataFrames: tokens, statements, checked names, plans."""
