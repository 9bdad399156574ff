"""Operators over streams: an extension, with the batch operators' meaning where both exist."""
