import pytest

from tierspark.functions.ages import SECOND, parse_age, whole_seconds

HOUR = 3600 * SECOND


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("7d", 168 * HOUR),
        ("1.5d", 36 * HOUR),
        ("168h", 168 * HOUR),
        ("30m", HOUR // 2),
        ("1h30m", HOUR + HOUR // 2),
        ("1.5h", HOUR + HOUR // 2),
        (".5s", SECOND // 2),
        ("1.s", SECOND),
        ("0", 0),
        ("0s", 0),
        ("+5s", 5 * SECOND),
        ("1us2µs3μs", 6_000),
        ("1ms1ns", 1_000_001),
    ],
)
def test_valid(text, want):
    assert parse_age(text) == want


@pytest.mark.parametrize("text", ["", "7dx", "not-a-duration", "-1h", "5", "1h 2m", "h", "1.2.3s", "d", "1d2h", "300000d", "٣s"])
def test_invalid(text):
    with pytest.raises(ValueError):
        parse_age(text)


def test_seconds_are_cut():
    assert whole_seconds(parse_age("1999ms")) == 1
