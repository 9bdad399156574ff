"""Page images: one row for a page, decoded and measured inside Arrow batches, facts as rows."""
