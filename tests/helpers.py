"""What several test modules use."""

import datetime as dt


def day(text):
    return dt.date.fromisoformat(text)
