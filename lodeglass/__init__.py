"""lodeglass: structural code analytics as lazy Spark plans."""
