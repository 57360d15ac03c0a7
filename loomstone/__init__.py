"""loomstone: a versioned analytics engine expressed as ordinary Spark plans."""
