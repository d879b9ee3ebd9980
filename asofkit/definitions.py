"""Feature declarations. Adding a ``WindowCount`` adds a feature to batch and stream alike."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from asofkit.schema import DAY_MS, HOUR_MS, LAST_EVENT_CAP_MS, MINUTE_MS, SESSION_GAP_MS


@dataclass(frozen=True)
class WindowCount:
    """Number of an entity's events in ``[as_of - window_ms, as_of)``; ``event=None`` is any type."""

    name: str
    window_ms: int
    event: str | None = None


# The feature set.
USER_WINDOWS = (
    WindowCount("user_events_5m", 5 * MINUTE_MS),
    WindowCount("user_events_1h", HOUR_MS),
    WindowCount("user_carts_1h", HOUR_MS, "addtocart"),
)
ITEM_WINDOWS = (
    WindowCount("item_views_5m", 5 * MINUTE_MS, "view"),
    WindowCount("item_views_1h", HOUR_MS, "view"),
    WindowCount("item_views_24h", DAY_MS, "view"),
    WindowCount("item_carts_1h", HOUR_MS, "addtocart"),
    WindowCount("item_carts_24h", DAY_MS, "addtocart"),
    WindowCount("item_purchases_24h", DAY_MS, "transaction"),
)
SESSION_FEATURES = (
    "session_events",
    "session_distinct_items",
    "session_carts",
    "session_duration_ms",
    "last_event_age_ms",
)
RETRIEVAL_FEATURES = ("ann_score", "ann_rank", "recent_rank")
USER_ITEM_FEATURES = ("ui_events", "ui_carts", "ui_age_ms", "ui_last_pos", "ui_is_last")


@dataclass(frozen=True)
class FeatureSet:
    """The features one job computes; the default is the standard 14."""

    user_windows: tuple[WindowCount, ...] = USER_WINDOWS
    item_windows: tuple[WindowCount, ...] = ITEM_WINDOWS
    session_gap_ms: int = SESSION_GAP_MS
    last_event_cap_ms: int = LAST_EVENT_CAP_MS

    @property
    def user_features(self) -> tuple[str, ...]:
        return tuple(w.name for w in self.user_windows) + SESSION_FEATURES

    @property
    def item_features(self) -> tuple[str, ...]:
        return tuple(w.name for w in self.item_windows)

    @property
    def user_retention_ms(self) -> int:
        return max(w.window_ms for w in self.user_windows)

    @property
    def item_retention_ms(self) -> int:
        return max(w.window_ms for w in self.item_windows)

    def only_items(self, names: Sequence[str]) -> FeatureSet:
        """Restrict the item windows to those a model reads."""
        kept = tuple(w for w in self.item_windows if w.name in names)
        return FeatureSet(self.user_windows, kept, self.session_gap_ms, self.last_event_cap_ms)


STANDARD = FeatureSet()
USER_FEATURES = STANDARD.user_features
ITEM_FEATURES = STANDARD.item_features
RANKER_FEATURES = RETRIEVAL_FEATURES + USER_ITEM_FEATURES + ITEM_FEATURES + USER_FEATURES
