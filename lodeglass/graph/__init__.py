"""Graph algorithms over edge tables."""
