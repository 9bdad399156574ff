"""Readers and writers: score JSON and MusicXML."""
