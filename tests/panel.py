"""An invented panel that several test modules share."""

from __future__ import annotations


def invented_panel():
    """Rows of three places over four years and two seasons, from a formula of this test suite."""
    rows = []
    for p, place in enumerate(("east", "north", "west")):
        for s, season in enumerate(("winter", "summer")):
            for y in range(2011, 2015):
                area = 12.1 + 9 * p + 4 * s + (1 + p - s) * (y - 2011) + 0.3 * ((5 * p + 3 * s + 7 * y) % 4)
                rows.append((place, y, season, area, 2 + p + s + y % 3, "good"))
    return rows


def invented_records():
    """One record per place and year; the middle place has the intervention."""
    return [(place, y, int(place == "north"), 1.5 + 0.25 * p + 0.125 * (y - 2011), "low" if p else "high")
            for p, place in enumerate(("east", "north", "west")) for y in range(2011, 2015)]
