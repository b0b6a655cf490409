"""Event-time windows and followers of a change log."""

from quarry.streaming.follow import Follower, apply_records, stream_log
from quarry.streaming.windows import event_sessions, event_windows

__all__ = ["Follower", "apply_records", "event_sessions", "event_windows", "stream_log"]
