"""Analytics over very large collections of text lines, as Spark plans."""
