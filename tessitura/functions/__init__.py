"""Scalar functions on columns: identifiers, ticks, pitches, boxes and scores. All stay in the JVM."""
