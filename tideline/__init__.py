"""Event-window analytics on Spark: sparse observation histories around calendar windows."""

from tideline.operators.windows import Calendar, Window

__all__ = ["Calendar", "Window"]
