"""Profiles of page recognition."""

from __future__ import annotations

from tessitura.plans import recognize


def test_profiles():
    assert recognize.profile_of("/x/cello/a.png").clef_sign == "F" and recognize.profile_of("/x/a.png") == recognize.Profile()
