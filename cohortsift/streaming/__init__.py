"""What runs as Structured Streaming: snapshots of the review log."""
